"""Phrases whose words stand together more often than apart, language by language.

Texts are lower-cased (A-Z), cut into pieces and these into words. Candidates are phrases of 2 to LONGEST
words with at least LEAST occurrences; each is cut in two at the place with the lowest score
floor(2,000,000 * a / (l + r)), and one that lies inside a longer candidate four fifths as frequent goes.

1. One pass over the texts makes chunks: words as numbers of the chunk's own list of words, with counts.
   Counts of words are summed by a shuffle of these lists; words with LEAST occurrences get ids, which go
   back to the chunks by a join, so no list of all words is held anywhere. Other words break phrases.
2. A phrase of k words is the id of its first k - 1 and the id of its last word, one 64-bit key without
   collisions. By Apriori it can only reach LEAST where its first and its last k - 1 words do. Among those,
   a screen of hashed counters (bincount of each batch, tree-summed) leaves what shares a counter of LEAST or
   more; nothing frequent is lost. Mappers hold at most `Sizes.folded` bits of it, of several counters each where it
   has more. They hand on the distinct keys of what they have read, in the screen's slices, where they meet the whole
   bits of their slice and are united. That is at most a key for each word, though more of them pass as more phrases
   become frequent.
3. The screened candidates get a minimal perfect hash in blocks of `Sizes.block` keys, made by tasks. Mappers find
   slots (the stored key decides), bincount them, and the arrays are tree-summed: exact counts by slot. An id
   is a block's first number plus the slot. A few blocks are broadcast at a time, a bounded size; more
   candidates mean more passes over the coded chunks.
4. Cuts read the counts of their two parts by these ids, in equality joins.

Arrays travel sparse, as places and counts within slices, so what moves grows with the text alone.
The screen has a counter for every other word up to 2^30 counters (128 MB as bits); far above that, some 100 GB of
text, it lets more candidates through, which then cost passes, not results.

A mapper's memory is that of `Sizes.batch` words, `Sizes.held` candidates, the folded screen and `Sizes.at_once` blocks (9
bytes a candidate), some 200 MB with its libraries, at any size of the input; a slice has `Sizes.width` places at most, and
tables with packed columns have row groups of 16 MB.

Null texts are empty, a null language is `und`, as is that word itself. Repeated rows count each. A phrase does
not cross a piece or a text; very long texts pass whole, in one chunk. Ties go as the order says, down to
the bytes of the phrase. Extra columns do not matter; an empty table has no phrases.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkstream.llm.common import drop_folder, small_batches, stored
from larkstream.llm.perfect_hash import PerfectHash, mixed
from larkstream.operators.order import global_rank

LEAST, LONGEST, TOP = 30, 4, 2000


class Sizes(NamedTuple):
    """What bounds memory; results do not depend on it."""

    chunk: int = 1 << 18  # words of a chunk
    slices: int = 256  # of each array that is summed
    batch: int = 1 << 18  # coded words that a mapper sums up at once
    block: int = 1 << 19  # candidates of a perfect hash
    at_once: int = 8  # blocks that are broadcast together
    held: int = 1 << 19  # distinct candidates that a mapper keeps before it hands them on
    counters: int = 1 << 30  # of the screen, at most
    folded: int = 1 << 27  # bits of the screen that a mapper holds
    width: int = 1 << 19  # places of a slice


#: Fixed values of the query contract: what ends a piece; words are separated by blanks and tabs.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


def words_of(text: str) -> list[list[bytes]]:
    """The words of each piece, in UTF-8."""
    return [w for piece in text.encode().lower().translate(_ENDS).split(b"\n") if (w := piece.split())]


_Kept, _Dropped = Callable[[DataFrame, str], DataFrame], Callable[[DataFrame], None]

#: Rows with packed columns are large: Parquet's own sizes hold 100 of them before they are looked at, and row groups, which are read as one batch, to 128 MB.
_ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}

# ---- chunks

_CHUNKS = "chunk string, lang string, words array<string>, counts array<long>, codes binary"


class _Coder:
    """Words of one language, numbered as they come."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.codes: list[int] = []

    def take(self, text: str) -> None:
        for piece in words_of(text):
            self.codes.extend(map(self.numbers.__getitem__, piece))
            self.codes.append(-1)

    def row(self, chunk: str, lang: str) -> dict:
        codes = np.array(self.codes, np.int32)
        counts = np.bincount(codes[codes >= 0], minlength=len(self.numbers))
        return {"chunk": chunk, "lang": lang, "words": [w.decode() for w in self.numbers], "counts": counts.tolist(), "codes": codes.astype("<i4").tobytes()}


def _chunks(docs: DataFrame, text: str, lang: str, sizes: Sizes) -> DataFrame:
    rows = small_batches(docs).select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, coders = TaskContext.get().partitionId(), 0, {}
        schema = pa.schema([("chunk", pa.string()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())])

        def flushed(of: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([coders.pop(of).row(f"{task}-{made}", of)], schema)

        for b in batches:
            for of, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                coder = coders.setdefault(of, _Coder())
                coder.take(t)
                if len(coder.codes) >= sizes.chunk:
                    made += 1
                    yield flushed(of)
            while sum(len(c.codes) for c in coders.values()) > 2 * sizes.chunk:  # many languages, each with little
                made += 1
                yield flushed(max(coders, key=lambda of: len(coders[of].codes)))
        for of in list(coders):
            made += 1
            yield flushed(of)

    return rows.mapInArrow(run, _CHUNKS)


def _coded(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """codes: the chunks' texts as ids of frequent words, -1 for what breaks a phrase."""
    listed = chunks.select("chunk", "lang", F.posexplode("words").alias("at", "word")).join(ids.select("lang", "word", "id"), ["lang", "word"])
    known = listed.groupBy("chunk").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("id"))  # a chunk's distinct words at most
    both = chunks.select("chunk", "codes", F.size("words").alias("n")).join(known, "chunk").select("codes", "n", "at", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids_of = np.full(b["n"][i].as_py() + 1, -1, np.int32)  # the last is where code -1 points
                ids_of[b["at"][i].values.to_numpy()] = b["id"][i].values.to_numpy()
                codes = ids_of[np.frombuffer(b["codes"][i].as_py(), "<i4")]
                lone = (codes >= 0) & (np.r_[-1, codes[:-1]] < 0) & (np.r_[codes[1:], -1] < 0)
                codes = np.where(lone, -1, codes)
                again = (codes < 0) & (np.r_[0, codes[:-1]] < 0)
                yield _codes_batch(codes[~again], None, None)

    return both.mapInArrow(run, _CODES)


#: Ids of words, of the phrases of k - 1 words that begin at each, and of those of k words, as far as they are known.
_CODED = ["codes", "grams", "found"]
_CODES = ", ".join(f"{c} binary" for c in _CODED)


def _codes_batch(*columns: np.ndarray | None) -> pa.RecordBatch:
    """None: not kept; for grams that means that they are the codes."""
    packed = [struct.pack("<q", 0) if c is None else struct.pack("<q", len(c)) + pa.compress(c.astype("<i4").tobytes(), "zstd", asbytes=True) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], _CODED)


def _unpacked(data: bytes) -> np.ndarray | None:
    n = struct.unpack_from("<q", data)[0]
    return np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd"), "<i4") if n else None


def _keys(codes: np.ndarray, grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of phrases of k words that Apriori allows, their keys, and the ids of their last k - 1 words."""
    if len(codes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    head, tail, last = grams[: len(codes) - k + 1], grams[1 : len(codes) - k + 2], codes[k - 1 :]
    at = np.flatnonzero((head >= 0) & (tail >= 0))
    return at, head[at].astype(np.int64) << 32 | last[at].astype(np.int64), tail[at]


def _read(batches: Iterator[pa.RecordBatch], batch: int) -> Iterator[list[np.ndarray]]:
    """The columns of some `batch` words at a time; chunks are kept apart by -1."""
    held, n = [], 0
    for b in batches:
        for i in range(b.num_rows):
            codes, *others = [_unpacked(c[i].as_py()) for c in b.columns]
            if codes is None:
                continue
            held.append([codes, *[codes if c is None else c for c in others]])
            n += len(codes) + 1
            if n >= batch:
                yield _merged(held)
                held, n = [], 0
    if held:
        yield _merged(held)


def _merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    gap = np.full(1, -1, np.int32)
    return [np.concatenate([x for row in held for x in (row[k], gap)]) for k in range(len(held[0]))]


# ---- sums of sparse arrays

_PARTS = "slice long, lane int, at binary, n binary"


def _parts(places: np.ndarray, counts: np.ndarray, lane: int, width: int) -> Iterator[pa.RecordBatch]:
    """Ascending places with their counts, cut into slices."""
    if len(places):
        of = places // width
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(places)]
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        at = (places % width).astype("<u4")
        columns = [
            pa.array(of[cuts[:-1]], pa.int64()), pa.array([lane] * len(spans), pa.int32()),
            pa.array([at[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([counts[i:j].astype("<i8").tobytes() for i, j in spans], pa.binary()),
        ]
        for i in range(0, len(spans), 512):
            yield pa.RecordBatch.from_arrays([c.slice(i, 512) for c in columns], ["slice", "lane", "at", "n"])


LANES = 8
_Finish = Callable[[int, np.ndarray, np.ndarray], pa.RecordBatch | None]


def tree_sum(parts: DataFrame, width: int, finish: _Finish, schema: str) -> DataFrame:
    """What `finish` makes of each slice: its number, places and their sums. Each lane of a slice is summed first, then its lanes: no task reads all parts of a slice."""

    def lane_sum(s: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        row = [pa.array([s], pa.int64()), pa.array([0], pa.int32()), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([n.astype("<i8").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(row, ["slice", "lane", "at", "n"])

    def level(rows: DataFrame, keys: list[str], done: _Finish, kind: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total = None, None

            def made() -> Iterator[pa.RecordBatch]:
                at = np.flatnonzero(total)
                if (out := done(now[0], at, total[at])) is not None:
                    yield out

            for b in batches:
                for s, lane, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (s, lane) != now:
                        if now:
                            yield from made()
                        now, total = (s, lane), np.zeros(width, np.int64)
                    total[np.frombuffer(at, "<u4")] += np.frombuffer(n, "<i8")  # places of a part are distinct
            if now:
                yield from made()

        return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, kind)

    return level(level(parts, ["slice", "lane"], lane_sum, _PARTS), ["slice"], finish, schema)


# ---- candidates


def _width(places: int, sizes: Sizes, unit: int = 8) -> int:
    """Places of a slice, a multiple of `unit`."""
    return max(1, min(-(-places // (unit * sizes.slices)), sizes.width // unit)) * unit


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether these bits are set."""
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _screened(coded: DataFrame, k: int, counters: int, sizes: Sizes, kept: _Kept, dropped: _Dropped) -> DataFrame:
    """key, tail and deal of phrases of k words that share a counter of LEAST or more."""
    spark, fold = coded.sparkSession, max(1, counters // sizes.folded)  # both are powers of two
    width = _width(counters, sizes, 8 * fold)
    places = lambda keys: (mixed(keys, 77) & np.uint64(counters - 1)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId() % LANES
        for codes, grams in _read(batches, sizes.batch):
            at, n = np.unique(places(_keys(codes, grams, k)[1]), return_counts=True)
            yield from _parts(at, n, lane, width)

    def full(s: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch | None:
        bits = np.zeros(width, bool)
        bits[at[n >= LEAST]] = True
        packed = [np.packbits(x).tobytes() for x in (bits, bits.reshape(-1, fold).any(axis=1))]
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), *[pa.array([x], pa.binary()) for x in packed]], ["slice", "bits", "folded"]) if bits.any() else None

    screen = kept(tree_sum(coded.select("codes", "grams").mapInArrow(count, _PARTS), width, full, "slice long, bits binary, folded binary"), "screen")
    own = width // fold // 8  # bytes of a slice
    bits = np.zeros(-(-counters // width) * own, np.uint8)
    for at, cut in zip(*screen.select("slice", "folded").toArrow().columns, strict=True):  # sizes.folded bits at most
        bits[at.as_py() * own : (at.as_py() + 1) * own] = np.frombuffer(cut.as_py(), np.uint8)
    held = spark.sparkContext.broadcast(bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(keys: np.ndarray, tails: np.ndarray) -> Iterator[pa.RecordBatch]:
            of = places(keys) // width
            order = np.argsort(of, kind="stable")
            of, keys, tails = of[order], keys[order], tails[order]
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else []
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            for i in range(0, len(spans), 512):
                some = spans[i : i + 512]
                columns = [pa.array([x[a:b].tobytes() for a, b in some], pa.binary()) for x in (keys, tails)]
                yield pa.RecordBatch.from_arrays([pa.array([of[a] for a, _ in some], pa.int64()), *columns], ["slice", "keys", "tails"])

        seen, seen_tails = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for codes, grams in _read(batches, sizes.batch):
            _, keys, tails = _keys(codes, grams, k)
            hit = _has(held.value, places(keys) // fold)
            seen, seen_tails = _distinct([seen, keys[hit]], [seen_tails, tails[hit]])
            if len(seen) >= sizes.held:
                yield from handed(seen, seen_tails)
                seen, seen_tails = seen[:0], seen_tails[:0]
        yield from handed(seen, seen_tails)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, tails, whole = None, [], [], None
        for b in batches:
            for s, *packed in zip(*b.columns, strict=True):
                s, key, tail, cut = (x.as_py() for x in (s, *packed))
                if s != now:
                    if keys:
                        yield from _candidates(*_distinct(keys, tails))
                    now, keys, tails, whole = s, [], [], None
                if cut is not None:  # a slice's bits come before its keys
                    whole = np.frombuffer(cut, np.uint8)
                    continue
                key, tail = np.frombuffer(key, np.int64), np.frombuffer(tail, np.int32)
                if fold > 1:
                    hit = _has(whole, places(key) - s * width)
                    key, tail = key[hit], tail[hit]
                keys.append(key)
                tails.append(tail)
                if sum(map(len, keys)) > sizes.held + 2 * len(keys[0]):
                    keys, tails = ([x] for x in _distinct(keys, tails))
        if keys:
            yield from _candidates(*_distinct(keys, tails))

    none = F.lit(None).cast("binary")
    rows = coded.select("codes", "grams").mapInArrow(pick, "slice long, keys binary, tails binary").withColumn("bits", none)
    if fold > 1:
        rows = rows.unionByName(screen.select("slice", none.alias("keys"), none.alias("tails"), "bits"))
    rows = rows.repartition("slice").sortWithinPartitions("slice", F.col("bits").isNull())
    candidates = kept(rows.mapInArrow(unite, "key long, tail long, deal int"), "candidates")
    held.destroy()
    dropped(screen)
    return candidates


def _distinct(keys: list[np.ndarray], tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the tail of each (a key has one)."""
    found, first = np.unique(np.concatenate(keys), return_index=True)
    return found, np.concatenate(tails)[first]


_DEALS = 20  # bits of `deal`


def _deal(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 61) >> np.uint64(64 - _DEALS)).astype(np.int64)


def _candidates(keys: np.ndarray, tails: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 1 << 16):
        key = keys[i : i + (1 << 16)]
        columns = [pa.array(key, pa.int64()), pa.array(tails[i : i + (1 << 16)].astype(np.int64), pa.int64()), pa.array(_deal(key).astype(np.int32), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "tail", "deal"])


def _planned(n: int, most: int) -> int:
    """Blocks of n candidates; dealt by hash, so they are planned a little under `most` keys."""
    return min(-(-n * 5 // (most * 4)), 1 << _DEALS)


def _blocks(candidates: DataFrame, blocks: int) -> DataFrame:
    """block, n, levels, keys and tails: the perfect hash of each block, its keys and their tails in the order of slots."""
    rows = candidates.withColumn("block", F.shiftright(F.col("deal").cast("long") * blocks, _DEALS).cast("int"))
    rows = rows.repartition("block").sortWithinPartitions("block")

    def made(block: int, keys: list[np.ndarray], tails: list[np.ndarray]) -> pa.RecordBatch:
        key, tail = np.concatenate(keys), np.concatenate(tails)
        table = PerfectHash.of(key)
        levels, stored_keys = table.packed()
        in_slots = np.zeros(len(key), np.int64)
        in_slots[table.find(key)] = tail
        columns = [pa.array([block], pa.int32()), pa.array([len(key)], pa.int64()), pa.array([levels], pa.list_(pa.binary())), pa.array([stored_keys], pa.binary()), pa.array([in_slots.astype("<i8").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "n", "levels", "keys", "tails"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, tails = None, [], []
        for b in batches:
            of = b["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if now is not None and of[i] != now:
                    yield made(now, keys, tails)
                    keys, tails = [], []
                now = int(of[i])
                keys.append(b["key"].to_numpy()[i:j])
                tails.append(b["tail"].to_numpy()[i:j])
        if keys:
            yield made(now, keys, tails)

    return rows.select("block", "key", "tail").mapInArrow(run, "block int, n long, levels array<binary>, keys binary, tails binary")


class _Table(NamedTuple):
    """A block's perfect hash: its number, the id of its first slot, and what is packed."""

    block: int
    base: int
    levels: list[bytes]
    keys: bytes


def _loaded(blocks: DataFrame, n_blocks: int, group: list[int], bases: dict[int, int]):
    """How many blocks there are, and the tables of these, some 5 MB each, for all tasks."""
    rows = blocks.where(F.col("block").isin(group)).select("block", "levels", "keys").toArrow()
    tables = [_Table(block, bases[block], levels, keys) for block, levels, keys in zip(*(c.to_pylist() for c in rows.columns), strict=True)]
    return blocks.sparkSession.sparkContext.broadcast((n_blocks, tables))


def _level(coded: DataFrame, k: int, counters: int, sizes: Sizes, kept: _Kept, dropped: _Dropped) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of k words (id, head, word, tail, f), and the chunks with their ids as grams."""
    table = coded
    if k > 2:  # what was found for the level before
        coded = table.select("codes", F.col("found").alias("grams"), "found")
    candidates = _screened(coded, k, counters, sizes, kept, dropped)
    n_blocks = _planned(candidates.count(), sizes.block)
    blocks = kept(_blocks(candidates, n_blocks), "blocks")
    blocks_of = sorted((r["block"], r["n"]) for r in blocks.select("block", "n").collect())
    bases, base = {}, 0
    for block, size in blocks_of:
        bases[block], base = base, base + size
    if base >= 1 << 31:
        raise ValueError(f"{base} candidates of {k} words do not fit 31 bits")
    counted = coded.sparkSession.createDataFrame([], "id long, f long")
    for i in range(0, len(blocks_of), sizes.at_once):
        group = blocks_of[i : i + sizes.at_once]
        tables = _loaded(blocks, n_blocks, [block for block, _ in group], bases)
        found = kept(_counts(coded, k, tables, _width(base, sizes), sizes), "counts")
        counted = found if not i else counted.unionByName(found)
        if k < LONGEST:
            first = bases[group[0][0]]
            known = np.zeros(sum(n for _, n in group), bool)
            known[found.select(F.col("id") - first).toArrow()[0].to_numpy()] = True
            held = coded.sparkSession.sparkContext.broadcast((first, np.packbits(known)))
            before, table = table, kept(_recoded(coded, k, tables, held, not i, i + sizes.at_once >= len(blocks_of), sizes), "coded")
            dropped(before)
            coded = table
            held.destroy()
        tables.destroy()
    return kept(_phrases(blocks, bases, counted), "phrases"), table


def _finder(tables) -> Callable[[np.ndarray], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Which gives, for keys, each table's first id and size, which of the keys are its own, and their slots."""
    n_blocks, packed = tables.value
    opened = [(t.block, t.base, PerfectHash.unpacked(t.levels, t.keys)) for t in packed]

    def find(keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        of = _deal(keys) * n_blocks >> _DEALS
        for block, base, table in opened:
            at = np.flatnonzero(of == block)
            slots = table.find(keys[at])
            own = slots >= 0
            yield base, len(table.keys), at[own], slots[own]

    return find


def _counts(coded: DataFrame, k: int, tables, width: int, sizes: Sizes) -> DataFrame:
    """id and f of the phrases in these blocks with at least LEAST occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, find = TaskContext.get().partitionId() % LANES, _finder(tables)
        for codes, grams in _read(batches, sizes.batch):
            for base, size, _, slots in find(_keys(codes, grams, k)[1]):
                n = np.bincount(slots, minlength=size)
                at = np.flatnonzero(n)
                yield from _parts(at + base, n[at], lane, width)

    def rows(s: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        hit = n >= LEAST
        return pa.RecordBatch.from_arrays([pa.array(at[hit] + s * width, pa.int64()), pa.array(n[hit], pa.int64())], ["id", "f"])

    return tree_sum(coded.select("codes", "grams").mapInArrow(count, _PARTS), width, rows, "id long, f long")


def _recoded(coded: DataFrame, k: int, tables, known, first: bool, last: bool, sizes: Sizes) -> DataFrame:
    """The chunks with the ids of frequent phrases of k words in these blocks as `found`, beside those found before.

    known: the first id of these blocks, and a bit for each of their ids that is frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, (start, frequent) = _finder(tables), known.value
        for codes, grams, found in _read(batches, sizes.batch):
            at, keys, _ = _keys(codes, grams, k)
            ids = np.full(len(codes), -1, np.int32) if first else found.copy()
            for base, _, own, slots in find(keys):
                ok = _has(frequent, slots + (base - start))
                ids[at[own[ok]]] = slots[ok] + base
            yield _codes_batch(codes, None if last else grams, ids)

    return coded.mapInArrow(run, _CODES)


def _phrases(blocks: DataFrame, bases: dict[int, int], counted: DataFrame) -> DataFrame:
    """id, head, word, tail and f of frequent phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, keys, tails in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, tail = np.frombuffer(keys, "<i8"), np.frombuffer(tails, "<i8")
                for i in range(0, len(key), 1 << 16):
                    cut = slice(i, i + (1 << 16))
                    columns = [np.arange(len(key))[cut] + bases[block], key[cut] >> 32, key[cut] & 0xFFFFFFFF, tail[cut]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "head", "word", "tail"])

    return blocks.select("block", "keys", "tails").mapInArrow(run, "id long, head long, word long, tail long").join(counted, "id")


# ---- scores


def _score(l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2,000,000 * f / (l + r)); the product is a decimal, as it may pass 64 bits."""
    return F.call_function("div", F.col("f").cast("decimal(28,0)") * F.lit(2_000_000).cast("decimal(7,0)"), (l + r).cast("decimal(20,0)")).cast("long")


def _lowest(*parts: tuple[str, str]) -> Column:
    """The cut with the lowest score, the first of equal ones; parts: the columns with the counts of each cut's two parts."""
    return F.array_min(F.array(*[F.struct(_score(F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate(parts, 1)]))


def _read_slots(df: DataFrame, table: DataFrame, by: str, **columns: str) -> DataFrame:
    """df with columns of the row of `table` whose id is in `by`, under new names."""
    return df.join(table.select(F.col("id").alias(by), *[F.col(c).alias(name) for name, c in columns.items()]), by)


def _scored(words: DataFrame, levels: list[DataFrame], kept: _Kept) -> list[DataFrame]:
    """Each level's phrases with lang, ids (of their words) and cut."""
    two, three, four = levels
    e = _read_slots(_read_slots(two, words, "head", l="f", lang="lang"), words, "word", r="f")
    e2 = kept(e.select("id", "f", "lang", "head", "word", F.array("head", "word").alias("ids"), _lowest(("l", "r")).alias("cut")), "two")
    e = _read_slots(_read_slots(three, e2, "head", f2="f", lang="lang", first="head", before="ids"), e2, "tail", g2="f")
    e = _read_slots(_read_slots(e, words, "first", f1="f"), words, "word", g1="f")
    e3 = kept(e.select("id", "f", "lang", "head", "tail", "first", F.concat("before", F.array("word")).alias("ids"), _lowest(("f1", "g2"), ("f2", "g1")).alias("cut")), "three")
    e = _read_slots(_read_slots(four, e3, "head", f3="f", lang="lang", first="first", front="head", before="ids"), e3, "tail", g3="f", back="tail")
    e = _read_slots(_read_slots(e, words, "first", f1="f"), words, "word", g1="f")
    e = _read_slots(_read_slots(e, e2, "front", f2="f"), e2, "back", g2="f")
    e4 = e.select("id", "f", "lang", F.concat("before", F.array("word")).alias("ids"), _lowest(("f1", "g3"), ("f2", "g2"), ("f3", "g1")).alias("cut"))
    return [e2, e3, e4]


def _not_inside(phrases: DataFrame, longer: DataFrame | None) -> DataFrame:
    """Without those in a longer phrase four fifths as frequent. One word more is enough to look at: what is in a
    still longer one is also in a phrase between, which is at least as frequent."""
    if longer is None:
        return phrases
    most = longer.select(F.explode(F.array("head", "tail")).alias("id"), F.col("f").alias("over")).groupBy("id").agg(F.max("over").alias("over"))
    big = lambda c, n: F.col(c).cast("decimal(28,0)") * n
    return phrases.join(most, "id", "left").where(F.col("over").isNull() | (big("over", 100) < big("f", 80))).drop("over")


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", sizes: Sizes = Sizes()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's TOP phrases."""

    spark, folders = docs.sparkSession, {}

    def kept(df: DataFrame, name: str) -> DataFrame:
        held, path = stored(df, name, _ROW_GROUPS)
        folders[id(held)] = held, path
        return held

    def dropped(df: DataFrame) -> None:
        drop_folder(spark, folders.pop(id(df))[1])

    chunks = kept(_chunks(docs, text, lang, sizes), "chunks")
    totals = kept(chunks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    listed = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    frequent = listed.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")).where(F.col("f") >= LEAST)
    words = kept(global_rank(frequent, -F.col("f"), F.col("lang"), F.col("word")).select("lang", "word", "f", (F.col("rank") - 1).cast("int").alias("id")), "words")
    n = totals.agg(F.sum("n")).first()[0] or 0
    counters = max(1 << 10, min(sizes.counters, 1 << max(0, n // 2 - 1).bit_length()))
    coded = kept(_coded(chunks, words), "coded")
    dropped(chunks)
    levels = []
    for k in range(2, LONGEST + 1):
        if k > 2 and levels[-1].isEmpty():  # then no longer phrase is frequent
            levels.append(levels[-1])
            continue
        level, coded = _level(coded, k, counters, sizes, kept, dropped)
        levels.append(level)
    scored = _scored(words, levels, kept)
    parts = [_not_inside(s, longer).select("lang", "ids", "f", "cut") for s, longer in zip(scored, [*levels[1:], None], strict=True)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = [F.col("cut.score").desc(), F.col("f").desc()]
    best = whole.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= TOP).drop("place")
    best = kept(best.withColumn("of", F.monotonically_increasing_id()), "best")  # with all ties of the last place
    spelt = best.select("of", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("of").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"])).alias("phrase"))
    ranked = best.join(spelt, "of").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.col("phrase"))))
    out = ranked.where(F.col("rank") <= TOP).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
