"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token of a text is predicted from the `SIDE` tokens on both sides of it; the sum of the logs of
these conditional probabilities scores the document. Tokens are words (A-Z lower-cased): the `KNOWN`
most frequent ones of the whole corpus have classes of their own, the others share hashed classes.
The network predicts the class, by a softmax of two levels (its cluster, and the class in it), the counts
of the whole corpus the word in the class:
log P(word) = log P(class | context) + log share of the word in its class. Of the N tokens and T
distinct words of a shared class a word that occurs n times has the share n / (N + T); the T shares
that remain stand for words never seen, which have 1 / (N + T) each (Witten-Bell).

1. Counts: each task counts its words, one shuffle adds them up over the whole corpus (it grows with
   the number of distinct words) into a table of all words; the `KNOWN` most frequent ones come to the
   driver, and so do the sums of the classes.
2. Training in numpy: texts are cut into pieces of `PIECE` tokens (with their context), and these are
   dealt into units of about `STEPS * BATCH` tokens by the hash of what they hold, copies each for itself.
   Starting from the same weights, each unit runs Adam over all its positions (or a seeded share of 1 in
   `every`), a small one so often that it takes some `STEPS` steps; the weights are averaged, each by its
   number of positions, within groups of units and then over groups. A first round over few units gives
   the weights from which the others start, so each position is learnt once. What is learnt does not
   depend on how the table is cut into partitions, what is gathered grows with the corpus, and the
   driver gets some weights of fixed size.
3. Scoring is a narrow map over whole texts, in blocks of positions, so memory is bounded. It holds the
   counts of at most `HEAD` words; the other words of each text are joined with the table of all words
   (words there that occur once add log 1 = 0), in whole numbers, so sums do not depend on their order.

Edge cases: null, empty and wordless texts have 0 tokens, pll 0 and a null mean; the context beyond
either end of a text is a padding class; repeated rows have equal scores; extra columns are ignored;
an empty table trains nothing and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkstream.llm.common import slices, small_batches, written
from larkstream.llm.textvec import UNBLANK, word_hashes

CLUSTERS, MEMBERS = 32, 32  # the softmax has two levels: the cluster of a class, and the class in it
CLASSES = CLUSTERS * MEMBERS  # class CLASSES is the padding
SHARED = 128
KNOWN = CLASSES - SHARED
SIDE, WIDTH = 3, 16
OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]
SHAPES = [(len(OFFSETS), CLASSES + 1, WIDTH), (WIDTH,), (WIDTH, CLUSTERS), (CLUSTERS,), (CLUSTERS, WIDTH, MEMBERS), (CLUSTERS, MEMBERS)]
HEAD = 1 << 18  # words whose counts each task holds
UNIT = 1 << 24  # logs of counts are added up as whole multiples of 1 / UNIT
PIECE = 4096  # tokens of a text that stay together in training
BATCH, STEPS = 8192, 256  # positions of a training step, and steps of a unit
BLOCK = 8192  # positions scored at once
FIRST = 8
LEARNT = "grp long, n long, w binary, loss double"
GROUPS = (256, 16)  # units' weights are added up in so many groups, then in fewer; as many reach the driver


_ONES = np.ones(max(CLUSTERS, MEMBERS), np.float32)


def _softmax(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Makes probabilities of the logits (held to +-60) in place; the logs of the own ones."""
    np.clip(logits, -60, 60, out=logits)
    held = logits[np.arange(len(own)), own]
    np.exp(logits, out=logits)
    total = logits @ _ONES[: logits.shape[1]]
    logits *= (1 / total)[:, None]
    return held - np.log(total)


def _by_cluster(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of positions by cluster, and where each cluster that occurs lies in it."""
    cluster = (target // MEMBERS).astype(np.uint8)
    ends = np.cumsum(np.bincount(cluster, minlength=CLUSTERS)).tolist()
    return np.argsort(cluster, kind="stable"), [(g, slice(a, b)) for g, a, b in zip(range(CLUSTERS), [0, *ends[:-1]], ends, strict=True) if b > a]


@dataclass
class Network:
    """context[o][class] sums to the hidden layer, which gives the logits of the masked token's cluster, and of its class in the cluster."""

    weights: list[np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return cls([(rng.standard_normal(s) * (0.1 if i in (0, 2, 4) else 0)).astype(np.float32) for i, s in enumerate(SHAPES)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        parts = np.split(flat.astype(np.float32), np.cumsum([int(np.prod(s)) for s in SHAPES])[:-1])
        return cls([p.reshape(s).copy() for p, s in zip(parts, SHAPES, strict=True)])

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def hidden(self, context: np.ndarray) -> np.ndarray:
        c, b = self.weights[:2]
        h = c[0][context[:, 0]]
        for k in range(1, len(OFFSETS)):
            h += c[k][context[:, k]]
        return np.tanh(h + b)

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, _, top, top_b, inner, inner_b = self.weights
        order, clusters = _by_cluster(target)
        h, own = self.hidden(context[order]), target[order]
        cluster, member = np.divmod(own, MEMBERS)
        logs = _softmax(h @ top + top_b, cluster)
        for g, at in clusters:
            logs[at] += _softmax(h[at] @ inner[g] + inner_b[g], member[at])
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def gradients(self, context: np.ndarray, target: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean loss, and its value."""
        c, _, top, top_b, inner, inner_b = self.weights
        n = len(target)
        order, clusters = _by_cluster(target)
        context, target = context[order], target[order]
        h = self.hidden(context)
        cluster, member = np.divmod(target, MEMBERS)
        p = h @ top + top_b
        loss = -_softmax(p, cluster).sum(dtype=np.float64)
        p[np.arange(n), cluster] -= 1
        p *= 1 / n
        back = p @ top.T
        g_inner, g_inner_b = np.zeros_like(inner), np.zeros_like(inner_b)
        for g, at in clusters:
            q = h[at] @ inner[g] + inner_b[g]
            loss -= _softmax(q, member[at]).sum(dtype=np.float64)
            q[np.arange(len(q)), member[at]] -= 1
            q *= 1 / n
            back[at] += q @ inner[g].T
            g_inner[g], g_inner_b[g] = h[at].T @ q, q.sum(0)
        back *= 1 - h * h
        gc = np.zeros_like(c)
        for k in range(len(OFFSETS)):
            order = np.argsort(context[:, k], kind="stable")
            held = context[order, k]
            first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
            gc[k][held[first]] = np.add.reduceat(back[order], first)
        return [gc, back.sum(0), h.T @ p, p.sum(0), g_inner, g_inner_b], float(loss) / n


class Trainer:
    """Adam over one unit's positions, in batches; `loss` adds up the loss of each position before it is learnt."""

    def __init__(self, net: Network, rate: float, batch: int = 0):
        self.net, self.rate, self.batch, self.steps, self.seen, self.loss = net, rate, batch or BATCH, 0, 0, 0.0
        self.m, self.v = [[np.zeros_like(w) for w in net.weights] for _ in range(2)]

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        for k in range(0, len(target), self.batch):
            own = target[k : k + self.batch]
            self.steps += 1
            self.seen += len(own)
            gradients, loss = self.net.gradients(context[k : k + self.batch], own)
            self.loss += loss * len(own)
            step = self.rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
            for w, g, m, v in zip(self.net.weights, gradients, self.m, self.v, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * (g * g)
                w -= step * m / (np.sqrt(v) + 1e-6)


@dataclass(frozen=True)
class Shares:
    """What tasks need to know of the counts of words: sums of the shared classes and the head of the table."""

    sums: np.ndarray  # log of tokens and distinct words of each shared class
    head: np.ndarray  # hashes, sorted
    logs: np.ndarray  # logs of their counts, in units

    @classmethod
    def of(cls, counts: DataFrame, known: list[int]) -> Shares:
        counts = counts.where(~F.col("word").isin(known)) if known else counts
        total = np.ones(SHARED)
        for r in counts.groupBy(F.col("word").bitwiseAND(SHARED - 1).alias("class")).agg((F.sum("n") + F.count("*")).alias("n")).collect():
            total[r["class"]] = r.n
        step = F.floor(F.log2("n") * 8)
        room, least = HEAD, None
        for r in counts.where("n > 1").groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
            room -= r["count"]
            if room < 0:
                break
            least = r.step
        held = counts.where("n > 1").where(step >= least if least is not None else F.lit(False)).select("word", log_units().alias("u")).toArrow()
        head, logs = held["word"].to_numpy().view(np.uint64), held["u"].to_numpy()
        order = np.argsort(head)
        return cls(np.log(total), head[order], logs[order])

    def of_words(self, words: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logs of the shares as far as they are known here, and which words the table of all words may add to."""
        shared = classes >= KNOWN
        out = np.where(shared, -self.sums[np.maximum(classes - KNOWN, 0)], 0.0)
        if not len(self.head):
            return out, shared
        near = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        here = shared & (self.head[near] == words)
        out[here] += self.logs[near[here]] / UNIT
        return out, shared & ~here


def log_units() -> Column:
    return F.round(F.log("n") * UNIT).cast("long")


@dataclass(frozen=True)
class Vocabulary:
    known: np.ndarray  # hashes, sorted
    number: np.ndarray  # their classes

    @classmethod
    def of(cls, hashes: list[int]) -> Vocabulary:
        h = np.array(hashes, np.int64).view(np.uint64)
        order = np.argsort(h)
        return cls(h[order], np.arange(len(h))[order])

    def classes(self, words: np.ndarray) -> np.ndarray:
        out = (KNOWN + words % np.uint64(SHARED)).astype(np.int64)
        if len(self.known):
            near = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
            out = np.where(self.known[near] == words, self.number[near], out)
        return out


def padded(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all texts with SIDE paddings around each, the places of real tokens, where each text's tokens begin, and the words."""
    words, at = word_hashes(texts, UNBLANK)
    n = np.diff(at)
    places = np.arange(len(words)) + SIDE * (np.repeat(np.arange(len(n)), n) + 1)
    line = np.full(len(words) + SIDE * (len(n) + 1), CLASSES, np.int64)
    line[places] = vocabulary.classes(words)
    return line, places, at, words


def around(line: np.ndarray, places: np.ndarray) -> np.ndarray:
    return line[places[:, None] + np.array(OFFSETS)]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Hash and count of every word of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            parts = [np.unique(word_hashes(b.column(0), UNBLANK)[0], return_counts=True) for b in slices(whole, 0)] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            h, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in parts]), len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    return small_batches(docs).select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int = KNOWN) -> list[int]:
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = KNOWN) -> list[int]:
    """Hashes of the most frequent words of all texts, most frequent first."""
    return most_frequent(word_counts(docs, text_col), most)


def pieces(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """Classes of all texts in pieces of PIECE tokens with SIDE more on either side, and how often each piece occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                line, places, at, _ = padded(batch.column(0), vocabulary)
                small = line.astype(np.uint16)
                held = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    held += [small[places[k] - SIDE : places[min(k + PIECE, b) - 1] + SIDE + 1].tobytes() for k in range(a, b, PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["line"])

    return small_batches(docs).select(text_col).mapInArrow(run, "line binary").groupBy("line").agg(F.count("*").alias("copies"))


def learning(start: np.ndarray, turn: int, every: int, rate: float, seed: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Trains one unit from `start`."""

    def run(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        trainer = Trainer(Network.of(start), rate)
        rng = np.random.default_rng((seed, turn, key[0]))
        lines = [np.frombuffer(x, np.uint16) for x in held.sort_values(["place", "line"])["line"]]
        line = np.concatenate(lines)
        inner = np.ones(len(line), bool)
        ends = np.cumsum([len(x) for x in lines])
        for k in range(SIDE):
            inner[ends - 1 - k] = False
            inner[np.concatenate([[0], ends[:-1]]) + k] = False
        places = np.flatnonzero(inner)
        share = -(-len(places) // every)
        times = max(1, round(STEPS / -(-share // BATCH)))
        for k in range(times):
            some = rng.permutation(places)[:share]
            for b in range(0, share, BATCH):
                trainer.rate = rate / (1 + turn / 2) * (1 - 0.9 * (k + b / share) / times)
                p = some[b : b + BATCH]
                trainer.learn(around(line, p), line[p])
        return pd.DataFrame({"grp": [key[0]], "n": [len(places)], "w": [trainer.net.flat().tobytes()], "loss": [trainer.loss / max(trainer.seen, 1)]})

    return run


def averaged(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
    """The mean of several units' weights and losses, each by its number of positions; summed in order of the units."""
    held = held.sort_values("grp")
    total, n = 0.0, int(held["n"].sum())
    for w, k in zip(held["w"], held["n"], strict=True):
        total = total + np.frombuffer(w, np.float32).astype(np.float64) * (k / n)
    return pd.DataFrame({"grp": [key[0]], "n": [n], "w": [total.astype(np.float32).tobytes()], "loss": [float((held["loss"] * held["n"]).sum() / n)]})


def train(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", every: int = 1, epochs: int = 1, rate: float = 0.03, seed: int = 3, gain: float = 0.01) -> Network:
    """A network from all positions of all texts (1 in `every`), each learnt once in an epoch.

    An epoch has two rounds: a few units, 1 in `FIRST`, give the weights from which all the others start. After
    the first one, `epochs` end early where one lowers the loss by less than `gain` of it; the loss is that of
    each position before it is learnt.
    """
    net = Network.fresh(seed)
    dealt = written(pieces(docs, vocabulary, text_col), "pieces")
    tokens = dealt.agg(F.sum((F.octet_length("line") / 2 - 2 * SIDE) * F.col("copies"))).first()[0]
    units = max(1, round((tokens or 0) / (STEPS * BATCH)))
    dealt = dealt.select("line", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("line", F.xxhash64("line", "copy").alias("place"))
    dealt = dealt.withColumn("grp", F.pmod(F.xxhash64("place"), F.lit(units)))
    early = -(-units // FIRST)
    shares = [F.col("grp") < early, F.col("grp") >= early] if units > 1 else [F.lit(True)] * 2
    before = float("inf")
    for epoch in range(epochs):
        loss = n = 0
        for turn, share in enumerate(shares, 2 * epoch):
            learnt = dealt.where(share).repartition(2 * units, "grp").groupBy("grp").applyInPandas(learning(net.flat(), turn, every, rate, seed), LEARNT)
            for groups in GROUPS:
                learnt = learnt.groupBy((F.col("grp") % groups).alias("grp")).applyInPandas(averaged, LEARNT)
            some = learnt.toPandas()
            if not some.empty:
                last = averaged((0,), some).iloc[0]
                net = Network.of(np.frombuffer(last.w, np.float32))
                loss, n = loss + last.loss * last.n, n + last.n
        if not n or loss / n > before * (1 - gain):
            break
        before = loss / n
    return net


def pseudo_likelihood(docs: DataFrame, net: Network, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, pll (sum of log-probabilities), mean_pll, perplexity.

    With the counts of all words these are of words, without them of classes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shares = Shares.of(counts, vocabulary.known.view(np.int64).tolist()) if counts is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                line, places, at, words = padded(batch.column(1), vocabulary)
                logs = np.zeros(len(places) + 1)
                more = np.zeros(len(places), bool)
                for k in range(0, len(places), BLOCK):
                    p = places[k : k + BLOCK]
                    logs[k : k + len(p)] = net.log_probs(around(line, p), line[p])
                    if shares:
                        known, more[k : k + len(p)] = shares.of_words(words[k : k + len(p)], line[p])
                        logs[k : k + len(p)] += known
                n = np.diff(at)
                total = np.where(n > 0, np.add.reduceat(logs, at[:-1]), 0.0)
                begin = np.concatenate([[0], np.cumsum(more)])[at].astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(begin), pa.array(words[more].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), rest], ["doc_id", "n_tokens", "pll", "rest"])

    scored = small_batches(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, pll double, rest array<long>")
    if counts is not None:
        scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
        rest = scored.select("row", F.explode("rest").alias("word"))
        added = rest.join(counts.where("n > 1"), "word").groupBy("row").agg(F.sum(log_units()).alias("added"))
        scored = scored.drop("rest").join(added, "row", "left").withColumn("pll", F.col("pll") + F.coalesce(F.col("added") / UNIT, F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", "pll", mean.alias("mean_pll"), F.exp(-mean).alias("perplexity"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    counts = written(word_counts(docs, text_col), "words")
    vocabulary = Vocabulary.of(most_frequent(counts))
    return pseudo_likelihood(docs, train(docs, vocabulary, text_col), vocabulary, id_col, text_col, counts)
