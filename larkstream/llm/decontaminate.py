"""Benchmark decontamination with suffix arrays over the training side.

The items' windows (each `window` consecutive words; a shorter item is one window) are the test
suffixes, each distinct one once, with the items and places it is from as a factor beside it. They go to
every task in blocks of at most `BLOCK_BYTES` of item text, as word numbers of four bytes, so what is
broadcast at once is bounded, and a larger benchmark takes more passes of the same map.

Each shard (some MB of training text) builds the array of its suffixes, sorted by their first words,
and every test suffix is found in it by two binary searches, which give all its verbatim occurrences.
Suffixes that can't hold a window, because a word among the first ones is in no item, are left out
beforehand; this loses nothing. Items are looked up once for each distinct set of items that a text
meets. Occurrences at consecutive places of a text are a stretch; the longest verbatim matches within
each distinct stretch of a shard are found once, by chaining places of one item. So the work is linear
in the text and in the distinct windows and items it meets; a distinct stretch holds a place for each of its windows
and each item that has it, so a passage of 500 words in 4,000 items takes some 130 MB while it is chained. No
shuffle and no second reading of the corpus.

Words are compared by 64-bit hashes, all of a window's words having to agree.

Edge cases: null or wordless texts have no words and are never hit; very long texts are shards of their
own; items without words have no window; equal items are counted each; a null item_id reads as the empty
string; repeated rows are judged each for itself; an empty table gives no rows, an empty benchmark leaves
every document clean; columns of the input travel in the struct `record`, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkstream.llm.common import slices, small_batches
from larkstream.llm.textvec import ALNUM, word_hashes

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 2 << 20


class TestSuffixes:
    """The windows of a block of items: for tasks the words' numbers only, from which each worker builds its tables."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.ids = np.array(["" if i is None else str(i) for i, _ in items], object)
        words, self.at = word_hashes(pa.array([t or "" for _, t in items], pa.string()), ALNUM)
        self.vocabulary, numbers = np.unique(words, return_inverse=True)
        self.numbers, self.window = (numbers + 1).astype(np.uint32), window
        self.windows: dict[int, Windows] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"windows": None}

    def built(self) -> dict[int, Windows]:
        """Windows by their number of words."""
        if self.windows is None:
            n = np.diff(self.at)
            size = np.minimum(n, self.window)
            self.windows = {}
            for m in np.unique(size[size > 0]).tolist():
                own = np.flatnonzero(size == m)
                each = n[own] - m + 1
                item = np.repeat(own, each)
                place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                self.windows[m] = Windows(keys(self.numbers[(self.at[item] + place)[:, None] + np.arange(m)]), item, place)
        return self.windows


def keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort in the same order (no number is 0)."""
    return np.ascontiguousarray(rows, ">u4").view(f"S{4 * rows.shape[1]}").ravel()


class Windows:
    """Distinct windows (sorted keys) of m words; window w occurs at item[k], place[k] for k from at[w] to at[w + 1]; its items are set number items_of[w]."""

    def __init__(self, every: np.ndarray, item: np.ndarray, place: np.ndarray):
        self.keys, of, n = np.unique(every, return_inverse=True, return_counts=True)
        order = np.lexsort((place, item, of))
        self.item, self.place = item[order].astype(np.int64), place[order].astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(n)))
        alone, self.items_of = np.unique(self.item[self.at[:-1]], return_inverse=True)
        self.sets = list(alone[:, None])  # of windows of one item; those of several follow
        known: dict[bytes, int] = {}
        for w in np.flatnonzero(n > 1).tolist():
            held = np.unique(self.item[self.at[w] : self.at[w + 1]])
            if len(held) > 1:
                self.items_of[w] = number = known.setdefault(held.tobytes(), len(self.sets))
                if number == len(self.sets):
                    self.sets.append(held)

    def longest(self, stretch: np.ndarray) -> list[tuple[int, int, int]]:
        """Matches (item, first window, windows) of consecutive windows with consecutive places of one item, none inside another; of equal ones the first item's."""
        n = self.at[stretch + 1] - self.at[stretch]
        step = np.repeat(np.arange(len(stretch)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[stretch], n)
        item, diagonal = self.item[k], step - self.place[k]
        order = np.lexsort((step, diagonal, item))
        item, diagonal, step = item[order], diagonal[order], step[order]
        new = np.ones(len(step), bool)
        new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (step[1:] != step[:-1] + 1)
        head = np.flatnonzero(new)
        runs = np.diff(np.append(head, len(step)))
        out, reach = [], -1
        for i in np.lexsort((item[head], -runs, step[head])).tolist():
            end = int(step[head[i]] + runs[i])
            if end > reach:
                out.append((int(item[head[i]]), int(step[head[i]]), int(runs[i])))
                reach = end
        return out


def match_shard(texts: pa.Array, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Numbers of words by text, a flag for each word that is hit, the items of each text (text, item), and matches (text, item, first word, words)."""
    words, at = word_hashes(texts, ALNUM)
    n_words, hit = np.diff(at), np.zeros(len(words) + 1, np.int64)
    if not len(words) or not len(tests.vocabulary):
        return n_words, hit[:-1] > 0, [], []
    near = np.minimum(np.searchsorted(tests.vocabulary, words), len(tests.vocabulary) - 1)
    numbers = np.where(tests.vocabulary[near] == words, near + 1, 0).astype(">u4")
    stops = np.append(np.flatnonzero(numbers == 0), len(words))  # where a run of words of the items ends
    runs = stops[np.searchsorted(stops, np.arange(len(words)))] - np.arange(len(words))
    text_end = np.repeat(at[1:], n_words)
    runs = np.minimum(runs, text_end - np.arange(len(words)))
    met: set[tuple[int, int]] = set()
    matches: list[tuple[int, int, int, int]] = []
    for m, windows in tests.built().items():
        suffixes = np.flatnonzero(runs >= m)
        if not len(suffixes):
            continue
        heads = keys(numbers[suffixes[:, None] + np.arange(m)])
        order = np.argsort(heads, kind="stable")
        array, heads = suffixes[order], heads[order]
        low, high = np.searchsorted(heads, windows.keys, "left"), np.searchsorted(heads, windows.keys, "right")
        some = np.flatnonzero(high > low)
        if not len(some):
            continue
        n = (high - low)[some]
        window = np.repeat(some, n)
        spot = array[np.repeat(low[some] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        np.add.at(hit, spot, 1)
        np.add.at(hit, spot + m, -1)
        order = np.argsort(spot)
        spot, window = spot[order], window[order]
        text = np.searchsorted(at, spot, "right") - 1
        for t, s in np.unique(np.stack([text, windows.items_of[window]], 1), axis=0).tolist():
            met.update((t, i) for i in windows.sets[s].tolist())
        begin = np.flatnonzero(np.concatenate(([True], (spot[1:] != spot[:-1] + 1) | (text[1:] != text[:-1]))))
        known: dict[bytes, list[tuple[int, int, int]]] = {}
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(spot)], strict=True):
            stretch = window[a:b]
            found = known.get(name := stretch.tobytes())
            if found is None:
                found = known[name] = windows.longest(stretch)
            matches += [(int(text[a]), i, int(spot[a] - at[text[a]]) + s, k - 1 + m) for i, s, k in found]
    return n_words, np.cumsum(hit[:-1]) > 0, sorted(met), matches


def _pass(tests: TestSuffixes, first: bool, carry: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map that adds what one block of items finds to what was found so far; without carry it returns no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SHARD_BYTES):
                n = batch.num_rows
                n_words, hit, met, found = match_shard(batch.column(1), tests)
                at = np.concatenate(([0], np.cumsum(n_words)))
                matches, items, hits, n_hit = [[[] for _ in range(n)], [[] for _ in range(n)], [None] * n, [0] * n] if first else [batch.column(k).to_pylist() for k in (4, 5, 6, 3)]
                for t, i, s, k in found:
                    matches[t].append({"item": tests.ids[i], "start": s, "words": k})
                for t, i in met:
                    items[t].append(tests.ids[i])
                for t in {t for t, _ in met}:
                    own = hit[at[t] : at[t + 1]]
                    if hits[t] is not None:
                        own = own | np.unpackbits(np.frombuffer(hits[t], np.uint8), count=len(own)).astype(bool)
                    hits[t], n_hit[t] = np.packbits(own).tobytes(), int(own.sum())
                texts = batch.column(1) if carry else pa.nulls(n, pa.string())
                columns = [batch.column(0), texts, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(matches, MATCHES), pa.array(items, pa.list_(pa.string())), pa.array(hits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text", "n_words", "n_hit", "matches", "items", "hit"])

    return run


MATCHES = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", carry: bool = True) -> DataFrame:
    """One row per document: record (the input columns; without carry all but the text), n_words, n_hit, n_items, items_sha256, contaminated, longest, matches (item, start, words: the longest verbatim matches, none inside another of its stretch)."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    rest = [c for c in docs.columns if c != text_col]
    rows = small_batches(docs).select(F.struct(*rest).alias("id"), F.col(text_col).cast("string").alias("text"))
    match = T.StructType().add("item", T.StringType()).add("start", T.LongType()).add("words", T.LongType())
    schema = T.StructType().add("id", rows.schema["id"].dataType).add("text", T.StringType()).add("n_words", T.LongType()).add("n_hit", T.LongType()).add("matches", T.ArrayType(match)).add("items", T.ArrayType(T.StringType())).add("hit", T.BinaryType())
    for b in range(blocks):
        block = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text").collect()  # BLOCK_BYTES, about
        tests = TestSuffixes([tuple(r) for r in block], window)
        rows = rows.mapInArrow(_pass(tests, b == 0, carry or b < blocks - 1), schema)
    items = F.array_sort(F.array_distinct("items"))
    columns = [(F.col("text") if c == text_col else F.col("id")[c]).alias(c) for c in docs.columns if carry or c != text_col]
    return rows.select(
        F.struct(*columns).alias("record"),
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max("matches.words"), F.lit(0)).alias("longest"),
        "matches",
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    return find_contamination(docs, benchmark, window).where(~F.col("contaminated")).select("record.*")
