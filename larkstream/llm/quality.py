"""Quality scores from a Bradley-Terry ranking.

A document is a vector of measures of its whole text (shares of kinds of characters, word lengths,
repetition, ...; never a label, language, source or id). Preference pairs (a document labelled 1 over
one labelled 0) teach a linear worth by the logistic loss on the difference of their features. Worths
are cut at the quantile of the training documents that separates their labels best, and mapped by a
logistic curve so that the cut has score 0.3.

The fit takes at most `sample_rows` labelled ids (a documented bound), the first ones by a hash of the id,
so the same ones at any cut of the tables; measuring, scoring and labelling cover every document. Measuring
is a narrow map; the only shuffles pick the labels and one text per id for the fit.

Edge cases: null and empty texts have a vector of zeros but for their constant terms, and so a score; very
long texts are measured whole; without two kinds of labels the worths are 0 and every document has the score
of the cut or above; rows that repeat an id give one of their texts (the first by hash) to the fit, repeated
labels the lowest; null ids are in no fit; an empty table gives no rows; columns of the input travel in the
struct `record`, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkstream.llm.common import slices, small_batches
from larkstream.llm.textvec import UNBLANK, shingles, text_buffer, word_hashes

CUT = 0.3
N_FEATURES = 25

_KINDS = np.zeros((256, 8), np.float64)
_KINDS[0x41:0x5B, 0] = 1  # capitals
_KINDS[0x61:0x7B, 1] = 1  # small letters
_KINDS[0x30:0x3A, 2] = 1  # digits
_KINDS[0x80:, 3] = 1  # other scripts
_KINDS[[0x2E, 0x2C, 0x3B, 0x3A, 0x3F], 4] = 1  # sentence marks
_KINDS[0x21, 5] = 1  # exclamation mark
_KINDS[[*range(0x23, 0x2B), 0x40, 0x5C, 0x5E, 0x60, *range(0x7B, 0x7F)], 6] = 1  # symbols
_KINDS[0x0A, 7] = 1  # line feed


def measure(texts: pa.Array) -> np.ndarray:
    """The features of each text, a row each."""
    raw, at = text_buffer(texts)
    words, word_at = word_hashes(texts, UNBLANK)
    out = np.zeros((len(texts), N_FEATURES))
    for i in range(len(texts)):
        a, b, w = at[i], at[i + 1], words[word_at[i] : word_at[i + 1]]
        if a == b:
            continue
        own = np.bincount(raw[a:b], minlength=256)
        shares = own @ _KINDS / (b - a)
        n = max(len(w), 1)
        _, times = np.unique(w, return_counts=True)
        three = shingles(w, 3)
        lines = np.flatnonzero(raw[a:b] == 0x0A)
        line_text = raw[a:b].tobytes().split(b"\n")
        long = [x for x in line_text if len(x) > 3]
        out[i, :8] = np.sqrt(shares)
        out[i, 8:] = (
            np.log1p(len(w)),
            np.log1p(len(w)) ** 2 / 10,
            min((b - a) / n, 40) / 10,
            len(times) / n,
            times.max(initial=0) / n,
            len(np.unique(three)) / max(len(three), 1),
            1 - len(set(long)) / max(len(long), 1),
            np.log1p(len(lines)),
            np.log1p((b - a) / (len(lines) + 1)),
            shares[5] * 10,
            shares[6] * 10,
            shares[0] * 4,
            own[0x7C] / (b - a) * 10,
            np.sqrt(own[0x3C] + own[0x3E]) / np.sqrt(b - a),
            np.sum(times * times) / (n * n),
            float(len(w) < 20),
            np.mean(w[1:] == w[:-1]) * 4 if len(w) > 1 else 0.0,
        )
    return out


@dataclass(frozen=True)
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float  # worth at the chosen quantile
    slope: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        worth = (expand((features - self.center) / self.scale) * self.weights).sum(1)  # row by row: a score does not depend on its neighbours
        z = self.slope * (worth - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def expand(x: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, with their squares and products."""
    x = np.clip(x, -4, 4)
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([x, x[:, i] * x[:, j]])


def fit(features: np.ndarray, labels: np.ndarray, rounds: int = 400, pairs: int = 1024, seed: int = 5, l2: float = 1e-3) -> Model:
    """Bradley-Terry by Adam on batches of preference pairs."""
    center, scale = features.mean(0) if len(features) else np.zeros(N_FEATURES), features.std(0) + 1e-6 if len(features) else np.ones(N_FEATURES)
    x = expand((features - center) / scale)
    w = np.zeros(x.shape[1])
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Model(center, scale, w, 0.0, 1.0)
    rng, m, v = np.random.default_rng(seed), np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = pair_gradient(x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)], w, l2)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.03 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    worth = x @ w
    # the quantile of worths that separates the labels best: the most right decisions, both labels weighing by their number
    order = np.argsort(worth, kind="stable")
    right = np.concatenate(([0], np.cumsum(labels[order] == 0))) + (labels == 1).sum() - np.concatenate(([0], np.cumsum(labels[order] == 1)))
    k = int(np.flatnonzero(right == right.max()).mean())
    cut = worth[order[0]] - 1 if k == 0 else (worth[order[k - 1]] + worth[order[min(k, len(order) - 1)]]) / 2
    return Model(center, scale, w, float(cut), slope_for(worth - cut, labels))


def pair_gradient(d: np.ndarray, w: np.ndarray, l2: float) -> np.ndarray:
    """Of the mean of log(1 + exp(-d w)) over the differences d, with l2 / 2 times the square of w."""
    return -(d * (1 / (1 + np.exp(np.clip(d @ w, -60, 60))))[:, None]).mean(0) + l2 * w


def slope_for(worth: np.ndarray, labels: np.ndarray) -> float:
    """Steepness of the logistic curve through the cut under which the labels are likeliest."""
    base = np.log(CUT / (1 - CUT))
    grid = np.geomspace(0.05, 5, 40)
    loss = [np.logaddexp(0, np.where(labels == 1, -1, 1) * (s * worth + base)).mean() for s in grid]
    return float(grid[int(np.argmin(loss))])


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def measured(rows: DataFrame) -> DataFrame:
    """rows (id, quality, text) with the features in place of the text."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2):
                x = measure(b.column(2))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["id", "quality", "x"])

    return small_batches(rows).mapInArrow(run, f"id {kind}, quality int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text", usable=None) -> Model:
    """A model from at most `sample_rows` labelled documents (their features, some 200 bytes each, come to the driver)."""
    ids = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"))
    ids = ids.where(~held_out("id") if usable is None else usable)
    ids = F.broadcast(ids.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(sample_rows))  # a top-k: each task keeps sample_rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id")
    rows = rows.groupBy("id", "quality").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one")).select("id", "quality", "one.text")
    got = sorted(measured(rows).collect(), key=lambda r: r.id)  # at most sample_rows
    return fit(np.array([r.x for r in got]).reshape(-1, N_FEATURES), np.array([r.quality for r in got], int))


def _scored(model: Model, text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map of records (structs) whose field number `text` holds the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            pairs = pa.RecordBatch.from_arrays([whole.column(0), whole.column(0).field(text)], ["record", "text"])
            for b in slices(pairs, 1):
                score = model.scores(measure(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))], ["record", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """One row per document: record (all its columns), score, predicted. The text crosses to Python once, within its record."""
    rows = small_batches(docs).select(F.struct("*").alias("record"))
    schema = T.StructType().add("record", rows.schema["record"].dataType).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return rows.mapInArrow(_scored(model, docs.columns.index(text_col)), schema)
