"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A text's symbols are its characters (blank as U+2581, one put in front); a character outside the
vocabulary stands for its UTF-8 bytes. The adjacent pair of lowest rank (leftmost on ties) is popped
and merged again and again; the count is the initial symbols less the merges. No piece of the
vocabulary holds U+2581 after another character, nor a character outside it, so merges never cross
the start of a word: texts are counted word by word, and a worker remembers the counts of recent
words (a bounded memory, which changes speed only).

Models must take texts as they are, with one blank put in front; others are refused.

Edge cases: null and empty texts have 0 tokens; special strings are ordinary text; texts are counted
whole, however long; a vocabulary with pieces across words is counted in one piece per text; repeated
rows are counted each for itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from larkstream.llm.common import small_batches

BLANK = "▁"
PROBE = " Ａﬁ①  e\u0301 Ab\t\n"  # what usual normalisers change: widths, ligatures, runs of blanks, marks, ends
REMEMBERED, LONGEST = 400_000, 48  # words that a worker remembers, and how long they may be


def merge_ranks(model_file: str) -> dict[str, float]:
    """Piece to rank (lower merges first) for the ordinary pieces of a sentencepiece BPE model."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    if p.normalize(PROBE) != BLANK + PROBE.replace(" ", BLANK):
        raise ValueError(f"{model_file} changes texts before it cuts them")
    return {p.id_to_piece(i): -p.get_score(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))}


def count_symbols(word: str, ranks: dict[str, float]) -> int:
    """Symbols of `word` that are left when no pair can be merged."""
    n = len(word)
    left = sum(1 if c in ranks else len(c.encode()) for c in word)
    end = list(range(1, n + 1))  # of the symbol that starts here; 0: it was merged away
    prev = list(range(-1, n - 1))  # start of the symbol before
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two has changed since
        end[i], end[mid] = stop, 0
        left -= 1
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return left


class _Remembered(dict):
    """Counts of words, each without the blank before it; a word that starts a line holds the line feed instead."""

    def __init__(self, ranks: dict[str, float]):
        super().__init__()
        self.ranks, self.line_feed = ranks, 1

    def __missing__(self, word: str) -> int:
        n = 1 + count_symbols(word[1:], self.ranks) if word[:1] == "\n" else count_symbols(BLANK + word, self.ranks)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


class Counter:
    """Counts tokens of texts as the model's own library does."""

    def __init__(self, model_file: str):
        self.ranks = merge_ranks(model_file)
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in self.ranks) and not any("\n" in p for p in self.ranks)
        self.words = _Remembered(self.ranks)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = BLANK + text.replace(" ", BLANK)
        if not self.by_word:
            return count_symbols(text, self.ranks)
        if BLANK + BLANK in text:  # runs of blanks have pieces of their own
            return sum(count_symbols(w, self.ranks) if w[:2] == BLANK * 2 or w[:1] != BLANK else self.words[w[1:]] for w in re.findall(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+", text))
        return sum(map(self.words.__getitem__, text.replace("\n", BLANK + "\n").split(BLANK)[1:]))


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. One narrow map over the scan, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_file)
        for batch in batches:
            ids, texts = batch.columns
            n = pa.array([counter.count(t.as_py()) for t in texts], pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
