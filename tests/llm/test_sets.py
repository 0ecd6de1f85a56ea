"""Operators over whole tables: shards, mixture, copies, near copies, the pipeline; and the queries' contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from larkstream.llm import exact_dedup, mixing, near_dedup, queries, sharding

BLANKS = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def n_words(t):
    return len(WORD.findall(t or ""))


# ---- exact copies


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_exact_dedup(make, odd_rows, support):
    rows = odd_rows + [(500 + i, "the same  text") for i in range(40)] + [(490, "the same\ntext")]
    got = exact_dedup.exact_dedup(make(rows), support=support).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(BLANKS, " ", t or "")].append(i)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(
        (i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids
    )
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_keeps_whole_rows(make, odd_rows):
    docs = make(odd_rows)
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({re.sub(BLANKS, " ", t or "") for _, t in odd_rows})
    assert exact_dedup.without_copies(docs.where("false")).count() == 0


# ---- shards


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 5000])
def test_shards(make, odd_rows, bucket_bytes):
    docs = make(odd_rows)
    out = sharding.shuffle_into_shards(docs, 7, bucket_bytes=bucket_bytes)
    got = out.collect()
    assert Counter((r.record.doc_id, r.record.text) for r in got) == Counter(odd_rows)
    for r in got:
        text = (r.record.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(text) + 8, zlib.crc32(text))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(7)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = [r.record.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.record.doc_id is not None]
    assert order != sorted(order)


def test_shards_of_few_and_no_rows(make, tmp_path):
    got = sharding.shuffle_into_shards(make([(1, "a"), (2, "b")]), 24, path=str(tmp_path / "out"))
    assert got.count() == 2 and {r.slot for r in got.collect()} == {0}
    assert len(list((tmp_path / "out").glob("shard=*"))) == 2
    assert sharding.shuffle_into_shards(make([]), 24).count() == 0


def test_shards_do_not_depend_on_the_scan(make, odd_rows):
    """Rows of equal id and text keep their places among themselves only."""
    placed = lambda n: Counter((r.record.doc_id, r.record.text, r.shard, r.slot) for r in sharding.shuffle_into_shards(make(odd_rows, n), 5, bucket_bytes=20_000).collect())
    assert placed(1) == placed(3) == placed(17)


def test_shards_of_equal_records(spark):
    """Copies that would fill a bucket are spread over all of them."""
    docs = spark.createDataFrame([(None, "the same text")] * 600 + [(k, f"text {k}") for k in range(600)], "doc_id long, text string").repartition(4)
    rows, by_spread, n, total = sharding.scattered(docs, 17, 1000, "text")
    assert n == 1200 and by_spread.agg({"bytes": "max"}).first()[0] < 250 and rows.count() == 1200
    got = sharding.shuffle_into_shards(docs, 6, bucket_bytes=1000).collect()
    assert Counter((r.record.doc_id, r.record.text) for r in got) == Counter(map(tuple, docs.collect()))
    by = Counter(r.shard for r in got)
    same = Counter(r.shard for r in got if r.record.doc_id is None)
    assert set(by.values()) == {200} and max(same.values()) < 160


def test_bucket_offsets(spark):
    counts = spark.range(3000).selectExpr("id AS bucket", "id % 5 AS n")
    got = {r.bucket: r.offset for r in sharding.bucket_offsets(counts).collect()}
    run = 0
    for b in range(3000):
        assert got[b] == run
        run += b % 5


# ---- mixture


def water(sizes, weights, epochs):
    """By rounds: clamp, deal the rest again."""
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > epochs * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(epochs * sizes[i])
            left -= target[i]
        free -= over
    return target


@pytest.mark.parametrize("bits,seed", [(12, 1), (2, 0), (2, 2)])
def test_mixture(spark, monkeypatch, seed, bits):
    """With few slots and ranked places the border is refined several times."""
    import random

    monkeypatch.setattr(mixing, "BITS", bits)
    monkeypatch.setattr(mixing, "RANKED", 10_000 if bits > 2 else 3)

    r = random.Random(seed)
    names = [None, "é", "z", "B", "a", "中", "empty"]
    rows = []
    for k in range(600):
        s = r.choice(names[: 2 + 2 * seed]) if k % 3 else "z"
        rows.append((k, None if s == "empty" else " ".join(["w"] * r.randint(0, 30)), s))
    rows += [(900, None, "empty"), (None, "a b", "a"), (None, None, None), (5, "x y", "z"), (5, "x y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'t' AS target", "0 AS copies", "'s' AS slot").repartition(4)
    got = mixing.mix(docs).collect()
    assert Counter((x.record.doc_id, x.record.text, x.record.source) for x in got) == Counter(rows)
    order = sorted({s for _, _, s in rows if s is not None}) + [None]
    size = {s: sum(n_words(t) for _, t, x in rows if x == s) for s in order}
    target = dict(zip(order, water([size[s] for s in order], [k % 3 + 1 for k in range(len(order))], 3), strict=True))
    taken = Counter()
    for x in got:
        s = x.record.source
        assert x["size"] == n_words(x.record.text) and x.source_size == size[s] and x.target == pytest.approx(target[s])
        assert x.taken == x["size"] * x.copies and 0 <= x.copies <= 3
        taken[s] += x.taken
    assert all(abs(taken[s] - target[s]) <= 31 for s in order)
    again = mixing.mix(docs.repartition(2)).collect()
    assert Counter((x.record.doc_id, x.record.text, x.taken) for x in again) == Counter((x.record.doc_id, x.record.text, x.taken) for x in got)
    whole = mixing.mixed_rows(docs)
    assert whole.columns == docs.columns and whole.count() == sum(x.copies for x in got)


def test_mixture_of_equal_rows(spark, monkeypatch):
    """Of rows equal in id and text as many are taken as the target asks for, in salted groups; many sources are joined in two parts."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    rows = [(1, "a b c", "x")] * 900 + [(k, "d e", f"s{k % 8}") for k in range(300)] + [(None, "f", None)] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    assert Counter((x.record.doc_id, x.record.text, x.record.source) for x in got) == Counter(rows)
    order = sorted({s for _, _, s in rows if s}) + [None]
    size = {s: sum(n_words(t) for _, t, x in rows if x == s) for s in order}
    target = dict(zip(order, water([size[s] for s in order], [k % 3 + 1 for k in range(len(order))], 3), strict=True))
    taken = Counter()
    for x in got:
        taken[x.record.source] += x.taken
    assert all(abs(taken[s] - target[s]) <= 1.5 for s in order), (taken, target)


def test_mixture_ranks_no_records(spark):
    """The cut of a source is found on (source, place, size); texts are in no window and no exchange."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_mixture_of_nothing(make):
    assert mixing.mix(make([])).count() == 0
    assert [r.taken for r in mixing.mix(make([(1, None)])).collect()] == [0]


# ---- near copies


def shingle_set(t, size):
    w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return frozenset()
    k = min(size, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute_components(rows, size):
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(root(i), []).append(doc)
    return [(rows[i][0], len(sets[i]), min((d for d in least[root(i)] if d is not None), default=None)) for i in range(len(rows))]


@pytest.mark.parametrize("short", [16, 3])
@pytest.mark.parametrize("size", [4, 5])
def test_near_copies(make, odd_rows, monkeypatch, short, size):
    """With short lists of 3 most copies take the exact way for crowded nodes."""
    monkeypatch.setattr(near_dedup, "SHORT", short)
    got = near_dedup.near_duplicates(make(odd_rows), size=size).collect()
    want = brute_components(odd_rows, size)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_copies_that_only_strangers_link(make, monkeypatch):
    """A crowd around two centres, with members that are linked to other members only."""
    import random

    monkeypatch.setattr(near_dedup, "SHORT", 4)
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(120):
        w = list(base)
        for p in r.sample(range(150), r.randint(0, 8)):
            w[p] = f"e{r.randint(0, 40)}"
        rows.append((k, " ".join(w)))
    for k in range(120, 140):  # drift away step by step
        w = rows[-1][1].split()
        w[(k * 7) % 150] = f"d{k}"
        rows.append((k, " ".join(w)))
    got = near_dedup.near_duplicates(make(rows), size=4).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == Counter(brute_components(rows, 4))


def test_near_copies_kept_rows(make, odd_rows):
    docs = make(odd_rows)
    kept = near_dedup.without_near_copies(docs)
    want = brute_components(odd_rows, 5)
    empty = sum(n == 0 for _, n, _ in want)
    groups = {c for (_, n, c) in want if n}
    assert kept.columns == docs.columns and kept.count() == len(groups) + empty
    assert near_dedup.without_near_copies(docs.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 105), (105, 100), (200, 200)]
    got = {r.node: r.comp for r in near_dedup.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100}
    assert near_dedup.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_a_true_pair_is_hardly_missed():
    p = sum(math.comb(near_dedup.COORDS, k) * 0.8**k * 0.2 ** (near_dedup.COORDS - k) for k in range(near_dedup.MATCHES))
    assert p < 2e-6


# ---- the pipeline and the queries


EXTRA = "1 AS id_", "2 AS hash_", "3 AS stay", "'r' AS record", "4 AS key_id", "5 AS part", "'f' AS `from`", "6 AS place", "7 AS n", "8 AS node", "'s' AS spread", "9 AS bucket"


def odd_documents(spark):
    """The small table with null, empty and very long texts, null ids and sources, repeated rows, near copies and extra columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [r.text for r in docs.orderBy("doc_id").limit(12).collect()]
    odd = [(9000, None, "src1"), (9001, "", "src1"), (9002, " \n ", None), (None, some[0], "src2"), (None, some[0], "src2"), (9003, " ".join(some * 40), None)]
    odd += [(9010 + k, t.replace(" ", "  ") + " end", "src9") for k, t in enumerate(some)] + [(9010, some[0].replace(" ", "  ") + " end", "src9")]
    more = spark.createDataFrame(odd, "doc_id long, text string, source string").selectExpr("doc_id", "text", "'xx' AS lang", "source", "length(text)::long AS n_chars")
    return docs.unionByName(more.select(docs.columns)).selectExpr("*", *EXTRA)


def rows_of(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_each_stage_equals_its_brute_force_version(spark):
    import numpy as np
    import pyarrow as pa
    from tests.llm.test_maps import brute_contamination, plain_measures

    import corpus_pipeline
    from larkstream.llm import quality

    docs = odd_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    # quality: the stage keeps what a model fitted on the same labelled rows, with measures made word by word, accepts
    good = stages["quality"](spark, docs, SF)
    labels = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").collect():
        labels[r.doc_id].append(r.quality)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    texts = {i: t for i, t, _ in rows if i is not None}
    fit_ids = sorted(i for i in labels if i in texts and zlib.crc32(str(i).encode()) % 5)
    model = quality.fit(np.array([plain_measures(texts[i]) for i in fit_ids]), np.array([min(labels[i]) for i in fit_ids]))
    want = Counter(r for r in rows if model.scores(np.array([plain_measures(r[1])]))[0] >= 0.3)
    assert rows_of(good) == want and good.columns == docs.columns and 0 < sum(want.values()) < len(rows)

    def again(df):
        return spark.createDataFrame(df.collect(), docs.schema).repartition(3)

    # near copies: from each component of all survivors the row with the smallest id
    good = again(good)
    left = list(rows_of(good).elements())
    parts = brute_components([(i, t) for i, t, _ in left], 5)
    groups = defaultdict(list)
    for k, (row, (_, n, comp)) in enumerate(zip(left, parts, strict=True)):
        groups[("alone", k) if not n else ("in", comp)].append(row)
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values())
    near = stages["near_dedup"](spark, good, SF)
    assert rows_of(near) == want and near.columns == docs.columns and sum(want.values()) < len(left)
    # decontamination
    near = again(near)
    left = list(rows_of(near).elements())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute_contamination([t for _, t, _ in left], items, 10)
    clean = stages["decontamination"](spark, near, SF)
    assert rows_of(clean) == Counter(r for r, f in zip(left, found, strict=True) if not f[-1]) and any(f[-1] for f in found)
    # mixture: each source comes near its target, and each document out as often as any rule allows
    clean = again(clean)
    left = rows_of(clean)
    mixed = stages["mixing"](spark, clean, SF)
    order = sorted({s for _, _, s in left if s is not None}) + ([None] if any(s is None for _, _, s in left) else [])
    size = {s: sum(n_words(t) * n for (_, t, x), n in left.items() if x == s) for s in order}
    target = dict(zip(order, water([size[s] for s in order], [k % 3 + 1 for k in range(len(order))], 3), strict=True))
    taken = Counter()
    for (i, t, s), n in rows_of(mixed).items():
        times, whole = n / left[i, t, s], target[s] // size[s] if size[s] else 0
        assert times in (whole, whole + 1) and times <= 3
        taken[s] += n * n_words(t)
    assert all(abs(taken[s] - target[s]) <= max((n_words(t) for _, t, x in left if x == s), default=0) / 2 + 1 for s in order)
    # shards
    mixed = again(mixed)
    placed = stages["sharding"](spark, mixed, SF)
    assert rows_of(placed) == rows_of(mixed)
    by = defaultdict(list)
    for r in placed.collect():
        by[r.shard].append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    measured = quality.measure(pa.array([t for _, t, _ in rows], pa.string()))
    assert np.allclose(measured, [plain_measures(t) for _, t, _ in rows])


def test_pipeline_of_the_whole_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in at.collect())
    assert all(r.text == texts[r.doc_id] for r in out) and {r.shard for r in out} <= set(range(24))


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline

    at = odd_documents(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
    assert at.count() == 0 and set(at.columns) >= {"id_", "record", "shard", "slot"}


def test_queries_give_the_contract_columns(spark):
    want = {
        "op1_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op3_shards": "doc_id size text_crc32 law shard slot grown_shard",
        "op4_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op5_url_filter": "page_id host path rule verdict",
        "op6_mixture": "doc_id size source_size target taken",
        "op7_near_dedup": "doc_id n_shingles component_id kept",
        "op8_exact_dedup": "doc_id keep_id group_size kept text_sha256",
        "op9_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op10_quality": "doc_id held_out score predicted",
    }
    for name, columns in want.items():
        assert set(columns.split()) <= set(queries.queries()[name](spark, SF).columns)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    plain = lambda d: sorted((tuple(None if x is None or x != x else str(x) for x in r) for r in d.astype(object).itertuples(index=False)), key=repr)
    assert plain(got) == plain(want)


def test_eleven_queries_are_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_copies_lie_apart(spark):
    """Copies of a record are in one shard as often as chance says, and wherever the scan is cut."""
    n, shards = 300, 6
    rows = [(i, f"text {i} " + "x" * (i % 40)) for i in range(n) for _ in range(3)] + [(9999, "hot")] * 700
    made = []
    for parts in (3, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sharding.shuffle_into_shards(df, shards, bucket_bytes=2_000).selectExpr("record.doc_id", "record.text", "shard", "slot").collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted(rows)
        made.append(sorted(map(tuple, got)))
    assert made[0] == made[1]
    of = {}
    for doc, _, shard, _ in made[0]:
        of.setdefault(doc, []).append(shard)
    apart = sum(len(set(s)) == 3 for k, s in of.items() if k < n) / n
    assert abs(apart - 5 / 6 * 4 / 6) < 0.12  # three of six shards by chance
    assert max(Counter(of[9999]).values()) < 2 * 700 / shards
