"""From documents to a training mixture in shards: each stage is one operator, written and reread as Parquet.

Edge cases, stage by stage (each operator's module says more):

* quality: null and empty texts are scored like any other; repeated rows are judged each for itself;
  without usable labels nothing is rejected.
* near_dedup: null, empty and wordless texts are near nothing and stay; of rows equal in id and text one
  stays, as of any other group.
* decontamination: texts without words are clean; an empty benchmark leaves all.
* mixing: a null source is a source of its own; documents without words weigh nothing; each row comes out
  as often as it is taken.
* sharding: null texts have size 8; equal rows are separate records.

Very long texts pass whole. Ties are broken by ids and hashes. Extra columns, whatever their names, are kept
as they are, and an empty table passes through all stages. A stage keeps the columns of documents; the last
one adds size, text_crc32, shard and slot, in place of columns of those names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkstream.llm import decontaminate, mixing, near_dedup, quality, sharding
from larkstream.llm.common import drop_folder, stored, table
from larkstream.llm.queries import SHARDS


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where("predicted = 1").select("record.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    return near_dedup.without_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in shards, each document with its shard and slot."""
    added = ["size", "text_crc32", "shard", "slot"]
    return sharding.shuffle_into_shards(docs, SHARDS).select(*[f"record.`{c}`" for c in docs.columns if c not in added], *added)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: A trained classifier and seeded samples are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        if stage is not sharded:  # shards are written by their own stage
            docs, path = stored(result, name)
        if before:
            drop_folder(spark, before)
        before = path if stage is not sharded else None
    return result
