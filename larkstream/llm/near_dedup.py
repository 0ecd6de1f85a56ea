"""Near-duplicate classes by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every text becomes its set of word shingles and a MinHash signature of `COORDS` coordinates. Texts of
   equal sets form one node, so exact copies cost one signature and no pairs.
2. Nodes are posted under each (coordinate, value). Two sets of similarity 0.8 agree in `MATCHES`
   coordinates but for some 1 pair in 800,000 (binomial tail), so a pair with fewer is let go.
3. Lists of 2 to `SHORT` nodes give their pairs, and collisions are counted per pair. Long lists are
   skipped; each node knows how many of its coordinates lie in them, and a pair stays a candidate if
   its collisions plus the smaller of the two skipped numbers can still reach `MATCHES`.
4. A pair that meets in long lists only can pass only if both nodes have `MATCHES` coordinates there.
   For those crowded nodes the exact way is a prefix join on the shingles themselves: ordered by
   document frequency among crowded nodes, two sets that overlap enough share a shingle within a
   prefix whose length follows from their sizes. In each shingle's list only the members outside its
   largest class look for partners, so a big group of near copies meets its few strangers, not itself.
5. Candidates are confirmed on the full sets in two rounds. First each node's best partner, and each
   crowded node with the most central member of its lists, the one with the fewest rare shingles; then, after components are built, only
   candidates between different components. Links inside a component cannot change it, so components
   are those of the full link graph, less the links that step 2 lets go (some 1 in 800,000 of those at
   exactly 0.8, far fewer above) where no other way joins their ends.

Sets of the nodes that occur in a candidate or are crowded are read once and written down; pairs meet
them by joins on the node, and are compared in the JVM. Components come from alternating large-star and
small-star steps. Links, labels and signatures stay in tables; only counts reach the driver. Wherever a
key (a hub, a shingle's list, the centre of a star, a set with many copies) has more than `FAN` rows,
these are dealt over parts and the other side is repeated for each; lists are aggregated before they are
shuffled, and nothing gathers a group into one task but lists of at most `SHORT` nodes.

Edge cases: null, empty and wordless texts have no shingles and are linked with nothing; shorter texts
than a shingle are one shingle; very long texts are read whole, each as a slice of its own; a null id is never the smallest unless all are null; repeated rows
are copies of one node; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkstream.llm.common import BROADCAST_ROWS, cut, drop_folder, measured_cut, shared_folder, sized, slices, small_batches
from larkstream.llm.textvec import UNBLANK, mix, shingles, word_hashes

COORDS, MATCHES = 32, 14
SHORT = 16
FAN = 1024  # rows of one key, above which they are dealt over several tasks

_RNG = np.random.default_rng(97)
_MUL = _RNG.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, COORDS, dtype=np.uint64)


def signature(items: np.ndarray) -> np.ndarray:
    """The least of each of COORDS hashes over the items."""
    least = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(items), 2048):
        part = items[k : k + 2048, None] * _MUL + _ADD
        least = np.minimum(least, part.min(0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signed(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, text_hash (of the text), n (shingles), a and b (digest of the set), sig."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 2 << 20):
                words, at = word_hashes(batch.column(2), UNBLANK)
                n, a, b, sig = [], [], [], []
                for i in range(batch.num_rows):
                    own = np.unique(shingles(words[at[i] : at[i + 1]], size))
                    n.append(len(own))
                    a.append(own.sum(dtype=np.uint64).astype(np.int64))
                    b.append(mix(own ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64).astype(np.int64))
                    sig.append(signature(own) if len(own) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "text_hash", "n", "a", "b", "sig"])

    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n long, a long, b long, sig array<int>")


def hot_keys(counted: DataFrame, key: str, n: str) -> DataFrame | None:
    """The keys of counted (key, n) that stand for more than FAN rows, and in how many parts these are dealt; None if there are none.

    Beyond BROADCAST_ROWS of them only those with at least one in BROADCAST_ROWS of all their rows are dealt, which
    cannot be more; so the table may be broadcast at any size of the corpus.
    """
    many, seen = measured_cut(counted.where(F.col(n) > FAN).select(F.col(key).alias("hot"), F.col(n).cast("long").alias("of")), keys=F.count(F.lit(1)), rows=F.sum(F.col("of")))
    if not seen["keys"]:
        return None
    fan = FAN if seen["keys"] <= BROADCAST_ROWS else max(FAN, seen["rows"] // BROADCAST_ROWS)
    return F.broadcast(many.where(F.col("of") > fan).select("hot", F.ceil(F.col("of") / fan).cast("int").alias("parts")))


def fanned(left: DataFrame, right: DataFrame, key: str, spread: str, hot: DataFrame | None) -> DataFrame:
    """left joined with right on `key`; rows of left under a hot key are dealt over its parts by `spread`, and right's are repeated for each part."""
    if hot is None:
        return left.join(right, key)
    dealt = left.join(hot, F.col(key).eqNullSafe(F.col("hot")), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("parts")), F.lit(0).cast("long"))).drop("hot", "parts")
    copies = right.join(hot, F.col(key).eqNullSafe(F.col("hot")), "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0)).cast("long")))).drop("hot", "parts")
    return dealt.join(copies, [key, "part"]).drop("part")


def by_key(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """As `fanned`, with the hot keys counted first."""
    return fanned(left, right, key, spread, hot_keys(left.groupBy(key).agg(F.count(F.lit(1)).alias("n_")), key, "n_"))


class _Linker:
    """The search for links between nodes (node, doc_id, text_hash, n, sig) of documents docs."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, size: int, percent: int, id_col: str, text_col: str):
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
        self.nodes, self.size, self.percent, self.folder = nodes, size, percent, None

    def read_sets(self, wanted: DataFrame) -> DataFrame:
        """(node, items: hashes of all shingles) of the nodes in wanted; the corpus is read once for it, and the sets are written down."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, 1, 2 << 20):
                    words, at = word_hashes(batch.column(1), UNBLANK)
                    own = [np.unique(shingles(words[at[i] : at[i + 1]], size)).view(np.int64) for i in range(batch.num_rows)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["node", "items"])

        keys = sized(cut(self.nodes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))))
        met = self.docs.join(keys, (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
        spark, self.folder = self.docs.sparkSession, shared_folder(self.docs.sparkSession, "sets")
        met.mapInArrow(run, "node long, items array<bigint>").dropDuplicates(["node"]).write.parquet(self.folder)
        return spark.read.schema("node long, items array<bigint>").parquet(self.folder)

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (x, y) whose full sets are similar enough."""
        pairs = cut(pairs.select("x", "y"))
        hot = {c: hot_keys(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("k")), c, "k") for c in ("x", "y")}
        left = fanned(pairs, sets.select(F.col("node").alias("x"), F.col("items").alias("ix")), "x", "y", hot["x"])
        both = fanned(left, sets.select(F.col("node").alias("y"), F.col("items").alias("iy")), "y", "x", hot["y"])
        shared = F.size(F.array_intersect("ix", "iy"))
        alike = shared * 100 >= (F.size("ix") + F.size("iy") - shared) * self.percent
        near = (F.size("ix") * 100 >= F.size("iy") * self.percent) & (F.size("iy") * 100 >= F.size("ix") * self.percent)
        return cut(both.where(near & alike).select("x", "y"))

    def crowded_posts(self, crowded: DataFrame, sets: DataFrame) -> DataFrame:
        """(item, node, n, pos) for the shingles in each crowded node's prefix: pos is the shingle's place by rarity."""
        held = sets.join(crowded.select("node"), "node", "left_semi").select("node", F.size("items").cast("long").alias("n"), F.explode("items").alias("item"))
        df = cut(held.groupBy("item").agg(F.count(F.lit(1)).alias("df")))
        order = Window.partitionBy("node").orderBy("df", "item")
        posts = fanned(held, df, "item", "node", hot_keys(df, "item", "df")).withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
        prefix = F.expr(f"n - (n * {self.percent} + 99) div 100")  # whole numbers: no rounding shortens it
        return cut(posts.where((F.col("df") > 1) & (F.col("pos") <= prefix)).select("item", "node", "n", "pos"))

    @staticmethod
    def toward_hubs(posts: DataFrame) -> DataFrame:
        """Each node with the hub that most of its lists have: a list's hub is the member with the least rare shingles before the list's."""
        hubs = posts.groupBy("item").agg(F.min(F.struct("pos", "node")).alias("h")).select("item", F.col("h.node").alias("hub"))
        met = by_key(posts, hubs, "item", "node").where("hub <> node").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("met"))
        met = met.groupBy("node").agg(F.max(F.struct("met", "hub")).alias("best"))
        return met.select(F.least("node", "best.hub").alias("x"), F.greatest("node", "best.hub").alias("y"))

    def strangers(self, posts: DataFrame, comp: DataFrame) -> DataFrame:
        """Candidates of different components: in each list, those outside its largest component seek partners."""
        p = self.percent
        posts = cut(posts.join(comp, "node", "left").select("item", "node", "n", "pos", F.coalesce("comp", "node").alias("comp")))
        members = posts.groupBy("item", "comp").agg(F.count(F.lit(1)).alias("members"))
        main = cut(members.groupBy("item").agg(F.max(F.struct("members", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("members").alias("all")).where("comps > 1"))
        hot = hot_keys(main, "item", "all")
        posts = cut(fanned(posts, main.select("item", F.col("main.comp").alias("main")), "item", "node", hot))
        seek = posts.where("comp <> main").select("item", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "pos", "comp")])
        need = F.expr(f"((n + x_n) * {p} + {99 + p}) div {100 + p}")  # the least overlap that links them
        fits = (
            (F.col("comp") != F.col("x_comp"))
            & (F.col("pos") <= F.col("n") - need)
            & (F.col("x_pos") <= F.col("x_n") - need)
            & (F.col("n") * 100 >= F.col("x_n") * p)
            & (F.col("x_n") * 100 >= F.col("n") * p)
        )
        met = fanned(posts, seek, "item", "node", hot).where(fits)
        return met.select(F.least("node", "x_node").alias("x"), F.greatest("node", "x_node").alias("y")).distinct()

    def classes(self) -> DataFrame:
        """(node, comp) of all nodes that are linked, as full comparison would link them."""
        posted = self.nodes.select("node", F.posexplode("sig").alias("coord", "value"))
        posted = posted.select("node", (F.shiftleft(F.col("coord").cast("long"), 32) + F.col("value").cast("long")).alias("key"))
        lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        posted = cut(posted.join(lists, "key"))
        skipped = cut(posted.where(F.col("members") > SHORT).groupBy("node").agg(F.count(F.lit(1)).alias("skipped")))
        short = posted.where(F.col("members") <= SHORT).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("in"))
        pairs = short.select(F.posexplode("in").alias("i", "x"), "in").select("x", F.explode(F.expr("slice(in, i + 2, size(in))")).alias("y"))
        pairs = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("met"))
        sx, sy = skipped.select(F.col("node").alias("x"), F.col("skipped").alias("skipped_x")), skipped.select(F.col("node").alias("y"), F.col("skipped").alias("skipped_y"))
        reach = F.col("met") + F.least(F.coalesce("skipped_x", F.lit(0)), F.coalesce("skipped_y", F.lit(0)))
        pairs = cut(pairs.join(sx, "x", "left").join(sy, "y", "left").where(reach >= MATCHES).select("x", "y", reach.alias("reach")))
        crowded = cut(skipped.where(F.col("skipped") >= MATCHES).join(self.nodes.select("node", "n"), "node"))

        wanted = pairs.select(F.explode(F.array("x", "y")).alias("node")).unionByName(crowded.select("node")).distinct()
        sets = self.read_sets(wanted)
        best = pairs.groupBy("y").agg(F.max(F.struct("reach", "x")).alias("best")).select(F.col("best.x").alias("x"), "y")
        posts = None if crowded.isEmpty() else self.crowded_posts(crowded, sets)
        first = best if posts is None else best.unionByName(self.toward_hubs(posts)).distinct()
        first = cut(first)
        sure = self.confirmed(first, sets)
        comp = cut(components(sure))
        cx, cy = comp.select(F.col("node").alias("x"), F.col("comp").alias("comp_x")), comp.select(F.col("node").alias("y"), F.col("comp").alias("comp_y"))
        apart = F.coalesce("comp_x", "x") != F.coalesce("comp_y", "y")
        open_pairs = pairs.select("x", "y").join(cx, "x", "left").join(cy, "y", "left").where(apart).select("x", "y")
        if posts is not None:
            open_pairs = open_pairs.unionByName(self.strangers(posts, comp)).distinct()
        more = self.confirmed(open_pairs.join(first, ["x", "y"], "left_anti"), sets)
        drop_folder(self.docs.sparkSession, self.folder)
        if more.isEmpty():
            return comp
        # what is left to connect are components, each standing for its nodes
        between = more.join(cx, "x", "left").join(cy, "y", "left").select(F.coalesce("comp_x", "x").alias("x"), F.coalesce("comp_y", "y").alias("y"))
        joint = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("joint"))
        nodes = comp.unionByName(joint.join(comp, joint["comp"] == comp["node"], "left_anti").select(F.col("comp").alias("node"), "comp"))
        return nodes.join(joint, "comp", "left").select("node", F.coalesce("joint", "comp").alias("comp"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (x, y): comp is the smallest node it is connected with."""
    sums = {"n": F.count(F.lit(1)), "all": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    edges, seen = measured_cut(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), **sums)
    while seen["n"]:
        # large star: every larger neighbour is linked to the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(toward_least(both, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("k")), "v > u").distinct())
        # small star: every smaller neighbour and the node itself
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        small = toward_least(large, least, "v <> m").unionByName(least.select("u", F.col("m").alias("v")))
        edges, now = measured_cut(small.distinct(), **sums)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def toward_least(pairs: DataFrame, least: DataFrame, which: str) -> DataFrame:
    """(u, v) from each neighbour v in pairs (u, v) that `which` picks to m of its u in least (u, m, k: pairs of u)."""
    met = fanned(pairs, least.select("u", "m"), "u", "v", hot_keys(least, "u", "k"))
    return met.where(which).select(F.col("v").alias("u"), F.col("m").alias("v"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept (doc_id = component_id), first (one row of each component)."""
    rows = signed(small_batches(docs), size, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id()).withColumn("set", F.struct("n", "a", "b"))
    rows = cut(rows.drop("a", "b"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("best")
    nodes = rows.where("n > 0").groupBy("set").agg(F.min(F.struct("row_id", "doc_id", "text_hash", "sig")).alias("r"), best, F.count(F.lit(1)).alias("copies"))
    nodes = cut(nodes.select("set", "set.n", F.col("r.row_id").alias("node"), "r.doc_id", "r.text_hash", "r.sig", "best", "copies"))
    comp = _Linker(docs, nodes, size, percent, id_col, text_col).classes()
    named = cut(nodes.select("set", "node", "best").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    least = named.groupBy("comp").agg(F.min("best").alias("least"), F.count(F.lit(1)).alias("k"))
    named = by_key(named.select("set", "node", "comp"), least.select("comp", "least"), "comp", "node").select("set", "least")
    met = fanned(rows.where("n > 0").drop("sig"), named, "set", "row_id", hot_keys(nodes, "set", "copies"))
    alone = rows.where("n = 0").drop("sig").withColumn("least", F.lit(None).cast(named.schema["least"].dataType))
    met = met.unionByName(alone)
    component = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return met.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        (F.col("least").isNull() | (F.col("row_id") == F.col("least.row_id"))).alias("first"),
    )


def without_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, less all but the first of each component; edge cases as above.

    Records travel as a struct, so no column name can clash.
    """
    found = cut(near_duplicates(docs, size, percent, id_col, text_col))
    per_key = found.groupBy("doc_id", "text_hash").agg(F.count_if("first").alias("stay"), F.count(F.lit(1)).alias("rows"))
    per_key = cut(per_key.where("stay < rows").select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"), "stay"))
    rows = docs.select(F.struct("*").alias("record"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("key_id")) & (F.col("hash") == F.col("key_hash"))
    partly = per_key.where("stay > 0")  # rows that repeat id and text: as many stay as are first
    if partly.isEmpty():
        return rows.join(sized(per_key), same, "left_anti").select("record.*")
    repeated = rows.join(sized(partly), same).groupBy("key_id", "key_hash").agg(F.first("record").alias("record"))
    return rows.join(sized(per_key), same, "left_anti").select("record.*").unionByName(repeated.select("record.*"))
