"""The queries opN_<name>: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkstream.llm import chat_format, decontaminate, exact_dedup, lm_score, mixing, near_dedup, phrases, pii, quality, sharding, token_count, url_filter, vector_codes
from larkstream.llm.common import table

SHARDS = 24
TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), SHARDS).select(
        F.col("record.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("record.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=False)
    return found.select(F.col("record.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("record.doc_id", quality.held_out("record.doc_id").alias("held_out"), "score", "predicted")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    one = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat_format.read_back(chat_format.format_turns(talks.unionByName(one)))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.encode_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select("record.vec_id", "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """Token counts, shards, mixtures, trained scores and the spans a method adds are beyond SQL; tests hold them against brute force."""
    return {"op5_url_filter": OP5_SQL, "op7_near_dedup": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op9_decontamination": OP9_SQL, "op11_phrases": OP11_SQL, "op12_chat_format": OP12_SQL, "op13_vector_codes": _op13_sql()}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Written from the rules' meaning: labels of a host are lists, not patterns.
OP5_SQL = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, split_part(split_part(r, '?', 1), '#', 1) AS r FROM rest
), parts AS (
  SELECT page_id, translate(split_part(r, '/', 1), '{UPPER}', '{LOWER}') AS host, CASE WHEN contains(r, '/') THEN substr(r, position('/' IN r)) ELSE '' END AS path FROM cut
), rules AS (
  SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) AS t(rule, rule_host, rule_path, verdict)
), fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
), own AS (
  SELECT page_id, host, path,
    list_has_any(string_split(replace(host, '-', '.'), '.'), ['adult', 'bets', 'casino', 'malware', 'phishing', 'porn', 'spam', 'torrent', 'warez', 'xxx'])
    OR list_has_any(string_split(translate(path, '._-', '///'), '/')[2:], ['casino', 'malware', 'phishing', 'porn', 'torrent', 'warez'])
    OR lower(string_split(path, '.')[-1]) IN ('apk', 'exe', 'msi', 'scr') AND contains(path, '.')
    OR list_has_any([left(x, 4) FOR x IN string_split(host, '.')], ['xn--'])
    OR regexp_full_match(host, '(.*@)?[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}(:[0-9]*)?') AS blocked
  FROM parts
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM own LEFT JOIN fits USING (page_id)
"""

OP7_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), items AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM items a JOIN items b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
)
SELECT x AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id, min(y) = x AS kept FROM reach LEFT JOIN sizes ON sizes.doc_id = x GROUP BY x
"""

OP9_SQL = rf"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), tests AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
  FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), runs AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS k FROM words, (SELECT DISTINCT m FROM tests), unnest(range(1, len(w) - m + 2)) AS t(i)
), found AS (
  SELECT doc_id, item_id, i, m FROM runs JOIN tests USING (m, k)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN held USING (doc_id)
"""

OP8_SQL = r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM plain
WINDOW same AS (PARTITION BY t)
"""

OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), grams AS MATERIALIZED (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f FROM words, range(1, 5) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(i) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m >= 2 AND f >= 30
), frequent AS MATERIALIZED (
  SELECT lang, phrase, f FROM grams WHERE f >= 30
), cuts AS MATERIALIZED (
  SELECT lang, m, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS rest FROM candidates, unnest(range(1, m)) AS t(k)
), scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = c.head JOIN frequent y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
  SELECT lang, phrase, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(w[i : i + q - 1], ' ') AS phrase, max(a) AS over FROM candidates, range(2, 4) AS s(q), unnest(range(1, m - q + 2)) AS t(i) WHERE q < m GROUP BY ALL
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE over IS NULL OR 100::HUGEINT * over < 80::HUGEINT * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""

#: The marks' own lengths by role; a mark inside a text takes one character more.
OP12_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '(<<|<|\[)\\*(/?SYS>>|/?s>|/?INST\]|/?ROLE\]|SAYS\])'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 23 + length(role) END AS chars FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _op13_sql(rounds: int = 4) -> str:
    """Plain Lloyd rounds, all parts against all entries; products of doubles are exact for components of this size."""
    near = "SELECT x.row, x.p, min((xx - 2 * list_dot_product(x.c, b.c) + cc)::BIGINT) AS d, arg_min(e, (xx - 2 * list_dot_product(x.c, b.c) + cc) * 1024 + e) AS e FROM x JOIN b{k} b USING (p) GROUP BY ALL"
    step = """a{k} AS MATERIALIZED (
  SELECT row, p, e, c FROM (""" + near + """) JOIN x USING (row, p)
), m{k} AS (
  SELECT p, e, i, sum(v::BIGINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM a{k}) GROUP BY ALL
), b{next} AS MATERIALIZED (
  SELECT p, e, c, list_dot_product(c, c) AS cc FROM (
    SELECT p, e, coalesce(moved, b.c) AS c FROM b{k} b LEFT JOIN (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS moved FROM m{k} GROUP BY ALL) USING (p, e))
)"""
    return (
        r"""
WITH v AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), x AS MATERIALIZED (
  SELECT row, p, c, list_dot_product(c, c) AS xx FROM (SELECT row, p, list_transform(embedding[p * len(embedding) // 4 + 1 : (p + 1) * len(embedding) // 4], lambda y: floor(1024 * y::DOUBLE)) AS c FROM v, range(4) AS t(p))
), b0 AS MATERIALIZED (
  SELECT p, row - 1 AS e, c, xx AS cc FROM x WHERE row <= 256
), """
        + ", ".join(step.format(k=k, next=k + 1) for k in range(rounds))
        + f""", last AS MATERIALIZED (
  {near.format(k=rounds)}
), coded AS (
  SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY row
), books AS (
  SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM b{rounds})
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (row), books
"""
    )
