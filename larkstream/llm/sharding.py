"""Two-pass external shuffle into shards (DataFrame functions only).

Pass 1 reads the corpus once for its narrow statistics: each record's `spread`, a seeded hash of all its
columns (but maps, which have no hash), and its size. Totals fix the number of buckets, so that a bucket
holds about `bucket_bytes` however large the corpus is; a record's bucket is its spread modulo that number,
so it depends on the record alone and not on how the scan is cut. Records that are equal in all columns
are copies: they are counted, each gets its number among them, and the number is part of its spread, so copies lie
as far apart as any records, however many there are. (Where columns of maps or variants make records that cannot
be compared, copies are spread by their place in the scan.)

Pass 2 scatters: an exchange by bucket moves each record once, into the shuffle files of its bucket. The
records of a bucket are numbered in the order of their spread, and each goes to the place that the
bucket's permutation has for its number. Permutations are Spark's array ``shuffle`` (a seeded
Fisher-Yates), one for each bucket; with the bucket's offset in the global order of N records
they are a checkpointed table of four bytes a record. So a task never holds the records of a bucket, and
sorts spill. Each bucket is then written to its shard, and what is returned is read from there.

Law ``rows``: place g of N goes to shard ``g * S div N``, so counts differ by one at most and slots are
gapless from 0. Shards are runs of whole buckets, but for the bucket on a border.

Edge cases: null text has size 8 and the CRC of the empty text; repeated rows are separate records;
an empty table gives no rows; all input columns travel in the struct `record`, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkstream.llm.common import BROADCAST_ROWS, cut, shared_folder, text_bytes, written

GROUP = 1024  # buckets that are numbered together
MOST_PARTITIONS = 50_000  # of pass 2; beyond that a partition takes several buckets


def bucket_offsets(counts: DataFrame) -> DataFrame:
    """counts (bucket, n) with `offset`: the records in lower buckets, summed within groups of buckets and over groups."""
    grouped = counts.withColumn("grp", F.expr(f"bucket div {GROUP}"))
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    tops = grouped.groupBy("grp").agg(F.sum("n").alias("all")).select("grp", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(tops, "grp").select("bucket", (F.col("own") + F.col("base")).alias("offset"))


def scattered(docs: DataFrame, seed: int, bucket_bytes: int, text_col: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Records with their spread, how many records and bytes each spread has, and both totals."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = docs.select(
        F.struct("*").alias("record"),
        (text_bytes(text) + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), *hashed).alias("spread"),
    )
    by_spread = cut(rows.groupBy("spread").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
    n, total, alike = by_spread.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    if not alike:
        return rows, by_spread, n, total
    shared = by_spread.where("n > 1").select("spread")
    if alike <= BROADCAST_ROWS:
        twins, rest = rows.join(F.broadcast(shared), "spread", "left_semi"), rows.join(F.broadcast(shared), "spread", "left_anti")
        by_rest = by_spread.join(F.broadcast(shared), "spread", "left_anti")
    else:  # one shuffle of all records instead of two joins
        twins, rest, by_rest = rows, None, None
    copies = written(numbered_copies(twins) if len(hashed) == len(docs.columns) else twins.withColumn("spread", F.xxhash64("spread", F.monotonically_increasing_id())), "copies")
    by_copy = copies.groupBy("spread").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    if rest is None:
        return copies, by_copy, n, total
    return rest.unionByName(copies), by_rest.unionByName(by_copy), n, total


AT_ONCE = 1024  # copies that a task makes of a record


def numbered_copies(rows: DataFrame) -> DataFrame:
    """rows (record, size, text_crc32, spread) with the number of each among its equals in its spread.

    Equal records are counted, which sums them up before they move, and made anew from one of them, AT_ONCE at a
    time in different tasks.
    """
    counted = rows.groupBy("spread", "record").agg(F.first("size").alias("size"), F.first("text_crc32").alias("text_crc32"), F.count(F.lit(1)).alias("m"))
    parts = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {AT_ONCE}"))).alias("part")).repartition("spread", "part")
    number = F.explode(F.sequence(F.col("part") * AT_ONCE, F.least(F.col("m"), (F.col("part") + 1) * AT_ONCE) - 1)).alias("number")
    return parts.select("record", "size", "text_crc32", "spread", number).select("record", "size", "text_crc32", F.when(F.col("number") == 0, F.col("spread")).otherwise(F.xxhash64("spread", "number")).alias("spread"))


def permutations(spark: SparkSession, counts: DataFrame, buckets: int, seed: int) -> DataFrame:
    """For each bucket a permutation (order) of as many numbers as the fullest bucket has; less the ones beyond its own it is one of its own.

    Spark seeds ``shuffle`` by partition, so the rows come from a range cut in a fixed way, and nothing but the
    seed and the numbers of buckets and records decides.
    """
    most = counts.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    numbers = F.sequence(F.lit(0), F.lit(int(most) - 1))
    return spark.range(0, buckets, 1, -(-buckets // 64)).select(F.col("id").alias("bucket"), F.shuffle(numbers, seed).alias("order"))


def shuffle_into_shards(docs: DataFrame, n_shards: int, seed: int = 17, bucket_bytes: int = 16 << 20, text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per record: record (all input columns), size, text_crc32, slot, shard; read from the shards in `path`.

    Without a path they are written to a new folder below spark.checkpoint.dir. Each shard is a folder
    ``shard=K`` whose files hold its records in slot order within each file.
    """
    rows, by_spread, n, total = scattered(docs, seed, bucket_bytes, text_col)
    buckets = max(1, -(-total // bucket_bytes))
    bucket = F.pmod("spread", F.lit(buckets)).alias("bucket")
    counts = cut(by_spread.groupBy(bucket).agg(F.sum("n").alias("n")))
    orders = cut(bucket_offsets(counts).join(counts, "bucket").join(permutations(docs.sparkSession, counts, buckets, seed), "bucket"))
    orders = orders.select("bucket", "offset", F.filter("order", lambda k: k < F.col("n")).alias("order"))
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("spread"))
    dealt = rows.select("*", bucket).repartition(min(buckets, MOST_PARTITIONS), "bucket").withColumn("number", number).join(orders, "bucket")
    shard = F.expr(f"place * {n_shards} div {max(n, 1)}")
    placed = (
        dealt.select("record", "size", "text_crc32", (F.col("offset") + F.element_at("order", F.col("number"))).alias("place"))
        .withColumn("shard", shard)
        .select("record", "size", "text_crc32", F.expr(f"place - (shard * {max(n, 1)} + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard"))
    )
    return write_shards(placed, path or shared_folder(docs.sparkSession, "shards"))


def write_shards(placed: DataFrame, path: str) -> DataFrame:
    """The shards as written: each bucket's records go to files where the bucket lies."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed.sparkSession.read.schema(placed.schema).parquet(path)
