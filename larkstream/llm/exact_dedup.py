"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

1. Every row becomes (id, row_id, digest): SHA-256 of the text with each run of blanks as one space.
   The table is checkpointed, so row ids stay the same in all later steps.
2. Misra-Gries counters (``DataFrame.stat.freqItems``, at most 1/support of them) name every digest
   that holds more than `support` of the rows, and maybe some that do not.
3. Those candidates are counted exactly; the ones over the threshold are the winners, at most
   1/support rows by arithmetic, so broadcasting them is bounded whatever the corpus holds.
4. Rows of winners are resolved map-side by the broadcast; the rest, whose groups are each below
   `support` of the rows, go through one ordinary shuffle of ids and digests, and of the records where
   `carry` asks for them; otherwise texts do not move.

Edge cases: null text counts as empty; very long texts are hashed whole; a null id sorts after all others; of rows that agree in id and
text exactly one stays; an empty table gives an empty result; extra input columns are ignored unless
`carry` asks for them, and then sit in the struct `record`, so that no name can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkstream.llm.common import BLANKS, cut


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (and record, if carried)."""
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BLANKS, " ")
    more = [F.struct("*").alias("record")] if carry else []
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.sha2(plain.cast("binary"), 256).alias("digest"), *more))
    found = rows.stat.freqItems(["digest"], support).first()
    candidates = list((found and found[0]) or [])
    heavy_from = rows.count() * support
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))
    winners = (
        rows.where(F.col("digest").isin(candidates))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
        .where(F.col("group_size") > heavy_from)
    )
    winners = F.broadcast(cut(winners))  # at most 1/support rows
    heavy = rows.join(winners, "digest")
    same = Window.partitionBy("digest")
    rest = (
        rows.join(winners.select("digest"), "digest", "left_anti")
        .withColumn("group_size", F.count(F.lit(1)).over(same))
        .withColumn("first", F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).over(same))
    )
    return heavy.unionByName(rest).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_id") == F.col("first.row_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        *(["record"] if carry else []),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """The rows of docs that stay, with all their columns; edge cases as for `exact_dedup`."""
    return exact_dedup(docs, id_col, text_col, support, carry=True).where("kept").select("record.*")
