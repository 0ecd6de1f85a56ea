"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Statistics: one pass sums the words of each (source, slot), where a document's slot is one of `SLOTS`
equal ranges of its place, a seeded hash of its id and text. All else comes from that table, which has at
most SLOTS rows a source.

Water-filling: all sources share the total by weight; those above `max_epochs` times their size are
clamped there and what is left is dealt again by weight, until nobody is above. Only the water level
and two sums come to the driver in each round.

Sampling: with rate = target / source size, every document of a source is taken floor(rate) times, and
the order of places decides who is taken once more: all below the source's cut, none above it. The cut
lies in the source's border slot. A second pass takes down (source, place, size) of the border slots,
without the records; there the slot is cut into SLOTS ranges again, and again, until a source's border
holds at most `RANKED` places, whose sizes are then added up in order. So no task's work grows with a
source. A source misses its target by at most half of one document, and reruns agree.

Edge cases: null text has no words; very long texts are counted whole; a null source is a source of its
own, last in order; sources of no words get target 0; repeated rows are separate documents (rows equal in
id and text share a place; where the cut falls among them, some of them are taken, whichever); an empty
table gives no rows; input columns travel in the struct `record`, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkstream.llm.common import cut, word_count, written
from larkstream.operators.order import global_rank

BITS = 12
SLOTS = 1 << BITS
RANKED = 10_000  # places of a source that are ranked in one task
SALTS = 1024
BROADCAST_SOURCES = 100_000  # rows of the plan, some 100 bytes each, up to which it is broadcast


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """The level at which min(weight * level, max_epochs * size) sums to the sum of sizes."""
    total, weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, clamped = (total / weight if weight else 0.0), -1
    while True:
        cap = F.col("source_size") * max_epochs
        over = F.col("weight") * F.lit(level) > cap
        n, held, free = sources.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == clamped or not free:
            return level
        level, clamped = (total - held) / free, n


def place_of(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (from) with the plan (of, n, ...) of their source.

    The plan is broadcast up to BROADCAST_SOURCES sources; above that only the sources with at least one in
    BROADCAST_SOURCES rows are, which cannot be more, and the others are joined by a shuffle.
    """
    n, total = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), _same("of", "from"))
    large = F.col("n") * BROADCAST_SOURCES >= total
    heavy = F.broadcast(plan.where(large))
    return rows.join(heavy, _same("of", "from")).unionByName(rows.join(heavy.select("of"), _same("of", "from"), "left_anti").join(plan.where(~large), _same("of", "from")))


def border(cells: DataFrame, quotas: DataFrame) -> DataFrame:
    """cells (of, cell, size, n) and what is wanted of each source (of, quota): the last cell that begins within the quota, its n, and the quota left for it."""
    upto = Window.partitionBy("of").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most SLOTS cells of a source
    run = cells.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).withColumnRenamed("of", "from")
    met = run.join(quotas, _same("of", "from")).where(F.col("before") <= F.col("quota"))
    return met.groupBy("of").agg(F.max(F.struct("cell", "before", "n", "quota")).alias("b")).select("of", F.col("b.cell").alias("cell"), F.col("b.n").alias("held"), (F.col("b.quota") - F.col("b.before")).alias("quota"))


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 29) -> DataFrame:
    """One row per source: of, n (documents), source_size, target, whole, low (all places below are taken once more), cut_at (the last one that is), some (how many rows of that place), ties (rows there)."""
    rows = docs.select(F.col("source").alias("from"), place_of(seed).alias("place"), word_count(F.col("text")).alias("size"))
    shift = 64 - BITS
    slot = F.shiftright("place", shift)
    by_slot = cut(rows.groupBy(F.col("from").alias("of"), slot.alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    sources = global_rank(by_slot.groupBy("of").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n")), F.col("of").isNull(), F.col("of"))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = cut(sources.withColumn("weight", pick))
    level = water_level(sources, max_epochs)
    target = F.least(F.col("weight") * F.lit(level), F.col("source_size").cast("double") * max_epochs)
    sources = sources.withColumn("target", target).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    sources = sources.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    at = cut(border(by_slot, sources.select("of", F.col("extra").alias("quota"))))
    known = sources.select("of", "n").join(at.withColumnRenamed("of", "of_"), _same("of", "of_")).drop("of_")
    edge = cut(joined(rows, known).where(slot == F.col("cell")).select("from", "place", "size"))
    while shift > 0 and (at.agg(F.max("held")).first()[0] or 0) > RANKED:
        shift = max(shift - BITS, 0)
        inner = F.shiftright("place", shift)
        cells = edge.groupBy(F.col("from").alias("of"), inner.alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        at = cut(border(cells, at.select("of", "quota")))
        edge = cut(joined(edge, at.withColumnRenamed("held", "n")).where(inner == F.col("cell")).select("from", "place", "size"))
    places = edge.groupBy(F.col("from").alias("of"), F.col("place").alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    last = border_place(places, at.select("of", "quota"))
    found = sources.join(last.withColumnRenamed("of", "of_"), _same("of", "of_"), "left")
    low = at.select(F.col("of").alias("b_of"), F.shiftleft("cell", shift).alias("low"))
    return cut(found.join(low, _same("of", "b_of"), "left").select("of", "n", "source_size", "target", "whole", "low", "cut_at", "some", "ties"))


def border_place(places: DataFrame, quotas: DataFrame) -> DataFrame:
    """The last place of each source from which rows are taken: a row is if at most half of it lies beyond the quota."""
    upto = Window.partitionBy("of").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most RANKED places, or one
    run = places.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0))).withColumnRenamed("of", "from").join(quotas, _same("of", "from"))
    each = F.col("size") / F.col("n")
    some = F.when(F.col("size") == 0, F.when(F.col("before") <= F.col("quota"), F.col("n")).otherwise(0)).otherwise(F.least("n", F.greatest(F.lit(0), F.floor((F.col("quota") - F.col("before")) / each + 0.5)))).cast("long")
    taken = run.withColumn("some", some).where("some > 0").groupBy("of").agg(F.max(F.struct("cell", "some", "n")).alias("b"))
    return taken.select("of", F.col("b.cell").alias("cut_at"), F.col("b.some").alias("some"), F.col("b.n").alias("ties"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 29) -> DataFrame:
    """One row per document: record (all input columns), size, source_size, target, copies, taken."""
    plan = mixing_plan(docs, weights, max_epochs, seed)
    rows = docs.select(F.struct("*").alias("record"), place_of(seed).alias("place"), F.col("source").alias("from"), word_count(F.col("text")).alias("size"))
    rows = joined(rows, plan)
    more = F.when((F.col("place") < F.col("low")) | (F.col("place") <= F.col("cut_at")), 1).otherwise(0)
    if plan.where("some < ties").isEmpty():
        taken = rows.withColumn("more", more)
    else:
        tied = (F.col("place") == F.col("cut_at")) & (F.col("some") < F.col("ties"))
        clear = rows.where(~F.coalesce(tied, F.lit(False))).withColumn("more", more)
        taken = clear.unionByName(_some_of(rows.where(tied)))
    copies = F.least((F.col("whole") + F.col("more")).cast("int"), F.lit(max_epochs))
    return taken.select("record", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def _some_of(tied: DataFrame) -> DataFrame:
    """Rows of one place of each source, with `more` 1 for `some` of them: written down and numbered in salted groups."""
    tied = written(tied.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))), "ties")
    upto = Window.partitionBy("of").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = tied.groupBy("of", "salt").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0)))
    before = before.select(F.col("of").alias("b_of"), F.col("salt").alias("b_salt"), "before")
    number = F.row_number().over(Window.partitionBy("of", "salt").orderBy("place"))
    numbered = tied.withColumn("number", number).join(before, _same("of", "b_of") & (F.col("salt") == F.col("b_salt")))
    return numbered.withColumn("more", F.when(F.col("number") + F.col("before") <= F.col("some"), 1).otherwise(0)).drop("salt", "number", "b_of", "b_salt", "before")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 29) -> DataFrame:
    """The mixture itself: each row of docs, with its columns, as often as it is taken; edge cases as for `mix`."""
    return mix(docs, weights, max_epochs, seed).where("copies > 0").select(F.explode(F.sequence(F.lit(1), F.col("copies"))), "record").select("record.*")
