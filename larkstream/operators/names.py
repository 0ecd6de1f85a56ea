"""The first name that contains a text, for many texts and names: an inverted index of n-grams.

Names and texts are compared in lower case. Texts of up to GRAM characters are n-grams themselves, so the
least position of that n-gram is the answer. A longer text must hold all its n-grams of GRAM characters; if
some n-gram is in no name, neither is the text, else its rarest one gives a posting list, which is verified
from its beginning on: `STEP` postings of each open text at first, eight times as many in each further
round, until a name contains it or the list ends. Every step is an equality join, and texts that are in many
names are answered early.

Of names that are equal in lower case only the first can be an answer, so one stands for all. These get numbers
in the order of answers; n-grams and lists carry numbers alone, and n-grams are counted by hash while they are made.
Names are dealt anew before, so no task makes the n-grams of a whole file.

Where there are few names and few texts, comparing each with each is cheaper, and is what is done; the sizes
are counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkstream.operators.order import global_rank
from larkstream.session import cut

GRAM = 3
STEP = 32
FEW_NAMES, FEW_TEXTS = 5_000, 2_000
FEW_GRAMS = 100_000


def _grams(text: Column, n: int) -> Column:
    """Its distinct n-grams; none for texts that are shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))


def first_with_part(parts: DataFrame, names: DataFrame, few: tuple[int, int] = (FEW_NAMES, FEW_TEXTS)) -> DataFrame:
    """parts (_part) that some name of names (_pos, _name) contains in any case, with the least such _pos and its name as `_hit`.

    An empty part is in every name; null parts and names meet nothing. Ties of _pos go by name.
    """
    texts = parts.where(F.col("_part").isNotNull()).select(F.col("_part"), F.lower("_part").alias("_text")).distinct()
    held = names.where(F.col("_name").isNotNull()).select("_pos", "_name", F.lower("_name").alias("_low"))
    hit = F.min(F.struct("_pos", "_name")).alias("_hit")
    if held.limit(few[0] + 1).count() <= few[0] and texts.limit(few[1] + 1).count() <= few[1]:
        return texts.join(F.broadcast(held), F.col("_low").contains(F.col("_text"))).groupBy("_part").agg(hit)
    texts, numbered = cut(texts), _numbered(held)
    found = _indexed(texts.select("_text").distinct(), numbered).join(numbered.select("_nth", F.struct("_pos", "_name").alias("_hit")), "_nth")
    return texts.join(found, "_text").select("_part", "_hit")


def _numbered(names: DataFrame) -> DataFrame:
    """The first of all names (_pos, _name, _low) that are equal in lower case, with their place `_nth` among all first ones."""
    least = F.when(F.count_if(F.col("_pos").isNull()) == 0, F.min("_pos"))  # a null is before all others
    spelt = names.repartition("_pos").groupBy("_low", "_name").agg(least.alias("_pos"))
    first = spelt.groupBy("_low").agg(F.min(F.struct("_pos", "_name")).alias("_hit")).select("_low", "_hit._pos", "_hit._name")
    return cut(global_rank(first, F.col("_pos"), F.col("_name"), name="_nth"))


def _small(grams: DataFrame) -> DataFrame:
    """grams, to be broadcast where they are few, as those of an alphabet are."""
    return F.broadcast(grams) if grams.limit(FEW_GRAMS + 1).count() <= FEW_GRAMS else grams


def _indexed(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts (_text) with the least `_nth` of the names (_nth, _low) that contain them."""
    long = F.length("_text") > GRAM
    asked = cut(texts.where("_text <> ''").select("_text", long.alias("long"), F.explode(F.when(long, _grams(F.col("_text"), GRAM)).otherwise(F.array("_text"))).alias("gram")))
    every = F.concat(*[_grams(F.col("_low"), n) for n in range(1, GRAM + 1)])
    index = names.select("_nth", F.explode(every).alias("gram"))
    counted = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("_nth").alias("_nth"))
    stats = cut(counted.join(asked.select("gram").distinct(), "gram", "left_semi"))
    short = asked.where(~F.col("long")).join(stats, "gram").select("_text", "_nth")
    blank = texts.where("_text = ''").crossJoin(names.agg(F.min("_nth").alias("_nth"))).where("_nth is not null")  # one row by one row

    rarest = asked.where("long").join(stats.select("gram", "n"), "gram", "left").groupBy("_text")
    chosen = rarest.agg(F.count_if(F.col("n").isNull()).alias("lost"), F.min(F.struct("n", "gram")).alias("r")).where("lost = 0").select("_text", F.col("r.n").alias("n"), F.col("r.gram").alias("gram"))
    open_ = cut(chosen)
    postings = cut(global_rank(index.join(_small(open_.select("gram").distinct()), "gram", "left_semi"), F.col("gram"), F.col("_nth"), name="place"))
    heads = cut(postings.groupBy("gram").agg(F.min("place").alias("head")))
    postings = postings.join(_small(heads), "gram").select("gram", (F.col("place") - F.col("head")).alias("place"), "_nth")
    answers, low, step = [short, blank], 0, STEP
    while not open_.isEmpty():
        near = postings.where(F.col("place").between(low, low + step - 1)).join(names.select("_nth", "_low"), "_nth")
        met = cut(open_.join(near, "gram").where(F.col("_low").contains(F.col("_text"))).groupBy("_text").agg(F.min("_nth").alias("_nth")))
        answers.append(met)
        low, step = low + step, step * 8
        open_ = cut(open_.where(F.col("n") > low).join(met, "_text", "left_anti"))
    whole = answers[0]
    for more in answers[1:]:
        whole = whole.unionByName(more)
    return whole
