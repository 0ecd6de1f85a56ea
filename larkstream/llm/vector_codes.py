"""Product codes of vectors by Lloyd's rounds with bounds, on whole numbers throughout.

Each component becomes floor(1024 * x), vectors are cut into PARTS equal parts, and each part position has a
codebook of at most ENTRIES entries, which starts as that part of the vectors with the smallest ids. A round
gives every part its nearest entry (squared distance, ties to the lower index) and moves each entry to the
floored mean of its parts; entries without parts stay.

Rounds are exact but do not compare every part with every entry. Vectors lie in chunks; per chunk, part
position and entry there is a heap of the parts assigned to that entry, keyed by their slack: the distance to
the second nearest entry (lower bound) minus that to their own (upper bound), as of the last full comparison.
Since then the slack has shrunk by at most the way that its entry has moved plus the longest way of another
one. That sum is kept per entry (`Book.worn`), so a key is the slack plus the sum at that time, keys never
change, and only parts whose key the sum has reached are popped and compared with all entries again.

Chunks with their heaps are a table that each round reads and writes, apart from the records; between rounds
only the changes of the entries' sums meet, one row an entry, of a size that does not depend on the vectors.

Rows whose vector is null, empty, or holds a null or a component that is not finite are dropped, as are those
of another length than the vector of the smallest id; lengths that PARTS does not divide count as filled up
with zeros. Repeated rows and ids are rows of their own (ties of ids go by the vector, null ids come last).
Components of any size are computed exactly; an error above the greatest long is given as that. Extra columns
of whatever names are carried in `record`. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkstream.llm.common import drop_folder, sized, small_batches, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CHUNK = 4096  # vectors
EXACT = 1 << 22  # components up to this size have squared distances that doubles hold exactly, in up to 128 dimensions
LONG = (1 << 63) - 1


def whole(components: np.ndarray, dim: int) -> np.ndarray:
    """floor(1024 * x) of each component, a row for each vector, as int64 or, beyond 2^62, as Python's numbers."""
    given = np.asarray(components, np.float64).reshape(-1, dim)
    x = np.zeros((len(given), -(-dim // PARTS) * PARTS))
    x[:, :dim] = given
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    if np.all(np.abs(scaled) < 2.0**62):
        return scaled.astype(np.int64)
    exact = lambda v: (lambda a, b: a * SCALE // b)(*v.as_integer_ratio())
    return np.array([[exact(float(v)) for v in row] for row in x], dtype=object)


def _plain(x: np.ndarray) -> bool:
    return x.dtype != object and (x.size == 0 or max(int(x.max()), -int(x.min())) <= EXACT)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each entry, exactly: as doubles where these hold them, else as Python's numbers."""
    if _plain(x) and _plain(entries) and x.shape[1] <= 128:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]
    a, b = x.astype(object), entries.astype(object)
    return np.array([((b - row) ** 2).sum(1) for row in a], dtype=object).reshape(len(a), len(b))


def own_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    if _plain(x) and _plain(entries) and x.shape[1] <= 128:
        return ((x - entries) ** 2).sum(1)
    return ((x.astype(object) - entries.astype(object)) ** 2).sum(1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Book:
    """The codebook of one part position, with how far the bounds of each entry's parts have worn."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.worn = entries, np.zeros(len(entries))
        self.sums, self.counts = np.zeros(entries.shape, object), np.zeros(len(entries), object)

    def move(self, sums: dict[int, list[int]], counts: dict[int, int]) -> None:
        """Takes up the changes of sums and counts, and moves the entries to the floored means."""
        for k, n in counts.items():
            self.counts[k] += n
            self.sums[k] = self.sums[k] + np.array(sums[k], object)
        after = self.entries.astype(object)
        for k in np.flatnonzero(self.counts):
            after[k] = self.sums[k] // self.counts[k]
        if all(abs(v) < 1 << 62 for v in after.ravel()):
            after = after.astype(np.int64)
        way = _root(own_distances(after, self.entries))
        if len(way) > 1:  # the longest way of another entry
            top = np.sort(way)
            others = np.where(way == top[-1], top[-2] if top[-2] < top[-1] else top[-1], top[-1])
        else:
            others = np.zeros(len(way))
        self.worn = self.worn + (way + others) * (1 + 1e-12)
        self.entries = after


def compare(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its slack, by all entries."""
    d = distances(x, book.entries)
    near = np.argmin(d, 1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d], np.int64)
    rows = np.arange(len(x))
    upper = _root(d[rows, near])
    if d.shape[1] < 2:
        return near, np.full(len(x), np.inf)
    rest = d.copy()
    rest[rows, near] = np.inf
    lower = _root(rest.min(1))
    return near, lower - upper - 1e-9 * (1 + lower)  # less what the roots' rounding may have added


class Heaps:
    """The parts of one chunk at one part position: per entry a heap of (key, row)."""

    def __init__(self, x: np.ndarray, at: np.ndarray, keys: np.ndarray, order: np.ndarray):
        """order: all rows, entry by entry, each entry's in the order of its heap."""
        self.x, self.at, self.keys, self.order = x, at, keys, order

    @classmethod
    def first(cls, x: np.ndarray, book: Book) -> Heaps:
        at, slack = compare(x, book)
        made = cls(x, at, slack + book.worn[at], np.arange(len(x)))
        made.order = made._heaped({})
        return made

    def _lists(self) -> dict[int, list[tuple[float, int]]]:
        of = self.at[self.order]
        bounds = np.flatnonzero(np.diff(of)) + 1
        pairs = list(zip(self.keys[self.order].tolist(), self.order.tolist(), strict=True))
        cuts = [0, *bounds.tolist(), len(pairs)]
        return {int(of[i]): pairs[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i}

    def _heaped(self, heaps: dict[int, list[tuple[float, int]]]) -> np.ndarray:
        if not heaps:
            for row, (k, e) in enumerate(zip(self.keys.tolist(), self.at.tolist(), strict=True)):
                heaps.setdefault(e, []).append((k, row))
            for h in heaps.values():
                heapq.heapify(h)
        return np.array([row for e in sorted(heaps) for _, row in heaps[e]], np.int64)

    def again(self, book: Book) -> np.ndarray:
        """Rows whose bounds have worn through get their nearest entry anew; returns those rows that changed it."""
        heaps = self._lists()
        popped = []
        for e, h in heaps.items():
            while h and h[0][0] <= book.worn[e]:
                popped.append(heapq.heappop(h)[1])
        if not popped:
            return np.zeros(0, np.int64)
        rows = np.array(popped)
        near, slack = compare(self.x[rows], book)
        moved = rows[near != self.at[rows]]
        self.at[rows], self.keys[rows] = near, slack + book.worn[near]
        for row, e, k in zip(popped, near.tolist(), self.keys[rows].tolist(), strict=True):
            heapq.heappush(heaps.setdefault(e, []), (k, row))
        self.order = self._heaped({e: h for e, h in heaps.items() if h})
        return moved


def changes(x: np.ndarray, rows: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """By entry: how many parts it has won, less those lost, and their sum."""
    out: dict[int, tuple[int, np.ndarray]] = {}
    for sign, of in ((1, after), (-1, before)):
        if of is not None:
            for e in np.unique(of):
                held = x[rows[of == e]]
                n, s = out.get(int(e), (0, 0))
                out[int(e)] = n + sign * len(held), s + sign * held.astype(object).sum(0)
    return out



def _pack(x: np.ndarray) -> tuple[bool, bytes]:
    return (False, "\n".join(map(str, x.ravel().tolist())).encode()) if x.dtype == object else (True, x.astype("<i8").tobytes())


def _unpack(plain: bool, data: bytes, width: int) -> np.ndarray:
    if plain:
        return np.frombuffer(data, "<i8").reshape(-1, width)
    return np.array([int(v) for v in data.decode().split("\n")], dtype=object).reshape(-1, width)


def _round(columns: dict, books: list[Book], begin: bool) -> dict:
    """One chunk after a round: its state and what it adds to the entries' sums."""
    width = len(books) * books[0].entries.shape[1]
    x = _unpack(columns["plain"], columns["x"], width)
    each = width // len(books)
    state, part, entry, n, total = [], [], [], [], []
    for p, book in enumerate(books):
        mine = x[:, p * each : (p + 1) * each]
        if begin:
            heaps, rows, before = Heaps.first(mine, book), np.arange(len(mine)), None
        else:
            s = columns["state"][p]
            at = np.frombuffer(s["at"], "<u2").astype(np.int64)
            heaps = Heaps(mine, at.copy(), np.frombuffer(s["keys"], "<f8").copy(), np.frombuffer(s["heap"], "<u4").astype(np.int64))
            rows = heaps.again(book)
            before = at[rows]
        for e, (won, s) in changes(mine, rows, before, heaps.at[rows]).items():
            part.append(p), entry.append(e), n.append(won), total.append([str(v) for v in s])
        state.append({"at": heaps.at.astype("<u2").tobytes(), "keys": heaps.keys.astype("<f8").tobytes(), "heap": heaps.order.astype("<u4").tobytes()})
    return columns | {"state": state, "part": part, "entry": entry, "n": n, "total": total}


def _mapped(chunks: DataFrame, books: list[Book], begin: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield pa.RecordBatch.from_pylist([_round(row, books, begin)], b.schema)

    return chunks.mapInArrow(run, chunks.schema)


def kept_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has components, all of them finite numbers."""
    v = F.col(vector)
    return df.where(v.isNotNull() & (F.size(v) > 0)).where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _books(rows: DataFrame) -> tuple[int, list[Book]]:
    """The common length of the vectors and the codebooks at the start; ENTRIES rows at most reach the driver."""
    start = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v")
    head = start.limit(1).collect()
    if not head:
        return 0, []
    dim = len(head[0]["v"])
    initial = whole([r["v"] for r in start.where(F.size("v") == dim).limit(ENTRIES).collect()], dim)
    each = initial.shape[1] // PARTS
    return dim, [Book(initial[:, p * each : (p + 1) * each].copy()) for p in range(PARTS)]


def _move(chunks: DataFrame, books: list[Book]) -> None:
    """The changes of all chunks, summed by entry: PARTS * ENTRIES rows at most reach the driver."""
    one = chunks.select(F.explode(F.arrays_zip("part", "entry", "n", "total")).alias("c")).select("c.*")
    width = books[0].entries.shape[1]
    sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    found = one.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()
    for p, book in enumerate(books):
        mine = [r for r in found if r["part"] == p]
        book.move({r["entry"]: [int(r[f"s{i}"]) for i in range(width)] for r in mine}, {r["entry"]: r["n"] for r in mine})


CHUNKS = "chunk string, plain boolean, x binary, state array<struct<at:binary,keys:binary,heap:binary>>, part array<int>, entry array<int>, n array<long>, total array<array<string>>"


def _dealt(rows: DataFrame, dim: int) -> DataFrame:
    """Up to CHUNK vectors a row: chunk, records, and the components as whole numbers."""
    schema = T.StructType([T.StructField("chunk", T.StringType()), T.StructField("records", T.ArrayType(rows.schema["record"].dataType)), T.StructField("plain", T.BooleanType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                cut, k = b.slice(i, CHUNK), k + 1
                plain, data = _pack(whole(cut.column(0).flatten().to_numpy(), dim))
                records = pa.ListArray.from_arrays(pa.array([0, cut.num_rows], pa.int32()), pa.concat_arrays([cut.column(1)]))
                yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{k}"]), records, pa.array([plain]), pa.array([data], pa.binary())], ["chunk", "records", "plain", "x"])

    return rows.select("v", "record").mapInArrow(run, schema)


def books_digest(books: list[Book]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.entries.ravel()).encode()).hexdigest()


def _codes(chunks: DataFrame, books: list[Book]) -> DataFrame:
    """chunk, codes and errors of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = sum(b.entries.shape[1] for b in books)
        for b in batches:
            for row in b.to_pylist():
                x = _unpack(row["plain"], row["x"], width)
                each, at, error = width // len(books), [], 0
                for p, (book, s) in enumerate(zip(books, row["state"], strict=True)):
                    at.append(np.frombuffer(s["at"], "<u2").astype(np.int64))
                    error = error + own_distances(x[:, p * each : (p + 1) * each], book.entries[at[p]]).astype(object)
                codes = ["".join(f"{v:02x}" for v in c) for c in np.stack(at, 1).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), pa.array([codes], pa.list_(pa.string())), pa.array([[min(int(e), LONG) for e in error]], pa.list_(pa.int64()))], ["chunk", "codes", "errors"])

    return chunks.select("chunk", "plain", "x", "state").mapInArrow(run, "chunk string, codes array<string>, errors array<long>")


def encode_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """record, code (two hex digits a part), error, label_error (errors of the label's rows together) and codebooks_sha256."""
    spark = df.sparkSession
    rows = kept_vectors(small_batches(df), vector).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.struct("*").alias("record"))
    dim, books = _books(rows)
    if not books:
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]
        return rows.select("record", *none).where("false")
    dealt, _ = stored(_dealt(rows.where(F.size("v") == dim), dim), "vectors")
    empty = [F.array().cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(CHUNKS).fields[3:]]
    chunks, path = dealt.select("chunk", "plain", "x", *empty), None
    for k in range(ROUNDS + 1):
        chunks, new = stored(_mapped(chunks, books, k == 0), "codes")
        if path:
            drop_folder(spark, path)
        path = new
        if k < ROUNDS:
            _move(chunks, books)
    codes, _ = stored(_codes(chunks, books), "codes")
    drop_folder(spark, path)
    each = dealt.select("chunk", "records").join(codes, "chunk").select(F.explode(F.arrays_zip("records", "codes", "errors")).alias("c"))
    coded = each.select(F.col("c.records").alias("record"), F.col("c.codes").alias("code"), F.col("c.errors").alias("error"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    by_label = sized(coded.groupBy(F.col(f"record.`{label}`").alias("of")).agg(total.alias("label_error")))
    joined = coded.join(by_label, F.col(f"record.`{label}`").eqNullSafe(F.col("of")), "left")
    return joined.select("record", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
