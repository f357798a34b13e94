"""The registered queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, clusters, minhash, mixing, pieces, ppm, quality, sharding, simhash, substring, topk, urlfilter, whitening
from .common import scratch, store, table

SHARDS = 40
#: What both turns of the planted conversation say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"
#: Rules of the URL query: action, host, path.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"))


def _chat(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations").select(
        F.concat(F.lit("given:"), F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))).alias("tree"),
        "turn", "role", "text",
    )
    planted = [F.struct(
        F.lit("planted:-1").alias("tree"), F.lit(i).cast(given.schema["turn"].dataType).alias("turn"),
        F.lit(role).alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    ) for i, role in enumerate(("user", "assistant"))]
    every = given.union(spark.range(1).select(F.inline(F.array(*planted))))
    found = chat.digests(chat.formatted(chat.from_turns(every)))
    conv_id = F.expr("try_cast(substring_index(tree, ':', -1) AS bigint)")
    return found.select(conv_id.alias("conv_id"), *[c for c in found.columns if c not in ("tree", "rank")])


def _sharding(spark: SparkSession, sf: str) -> DataFrame:
    records = store(sharding.record_sizes(table(spark, sf, "documents")))
    sizes = store(sharding.slot_bytes(records))
    folder = scratch(spark, "slot-map")
    sharding.write_map(sharding.first_map(sizes, SHARDS), folder, 1)
    placed = sharding.place(records, sizes, sharding.read_map(spark, folder))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def _simhash(spark: SparkSession, sf: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judged(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "level", "distance",
    )


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return ppm.scores(table(spark, sf, "documents"))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encoded(table(spark, sf, "documents"))


def _url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf, "pages"), urlfilter.rule_table(spark, URL_RULES))


def _substring(spark: SparkSession, sf: str) -> DataFrame:
    return substring.repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf, "documents"))


def _minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.with_inertia(*clusters.clustered(table(spark, sf, "embeddings")))


def _whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(table(spark, sf, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k": _top_k,
        "op2_sharding": _sharding,
        "op3_simhash": _simhash,
        "op4_chat_format": _chat,
        "op5_quality_rules": _quality,
        "op6_sentencepiece": _pieces,
        "op7_lm_scoring": _scores,
        "op8_url_filters": _url_filter,
        "op9_substring_dedup": _substring,
        "op10_mixing": _mixing,
        "op11_minhash": _minhash,
        "op12_centroid_clusters": _clusters,
        "op13_whitening": _whitening,
    }


TOP_K_SQL = r"""
WITH vectors AS (
  SELECT ROW_NUMBER() OVER () AS n, vec_id,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

CHAT_SQL = r"""
WITH every AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length('<s>[INST] ' || ' [/INST]' || '</s>') + length(role) + length(text)
            + 2 * length(role) - length(replace(role, '\', '')) - length(role)
            + 2 * length(text) - length(replace(text, '\', '')) - length(text)
            + len(regexp_extract_all(role, '</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) AS size
  FROM every)
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(SUM(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

URL_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
judged AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
  END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""

REPEATS_SQL = r"""
WITH words AS (
  SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS run
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM words)),
firsts AS (SELECT run, MIN(doc_id) AS first_id FROM windows GROUP BY run),
removed AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM windows JOIN firsts USING (run) WHERE first_id < doc_id),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM words),
kept AS (
  SELECT doc_id, COUNT(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept
  FROM each ANTI JOIN removed USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - COALESCE(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(COALESCE(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""

# The level is found as the operator's docstring says: sources in the order of ceiling by weight.
MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(COALESCE(text, '')) AS digest, ROW_NUMBER() OVER (PARTITION BY doc_id, source, text) - 1 AS number
  FROM documents),
sums AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][place % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS ceiling FROM sums),
levels AS (
  SELECT *, ((SELECT SUM(source_size) FROM sums) * 1.5::DOUBLE - COALESCE(SUM(ceiling) OVER (
      ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / SUM(weight) OVER (ORDER BY ceiling / weight, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size,
         LEAST(ceiling, (SELECT MAX(level) FROM levels WHERE level * weight <= ceiling) * weight) AS target
  FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
draws AS (
  SELECT doc_id, size, source_size, target, rate,
         ('0x' || substr(md5(concat_ws(':', 'mix-1', doc_id, digest, number)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sizes JOIN rates ON sizes.source IS NOT DISTINCT FROM rates.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM draws"""


MINHASH_SQL = r"""
WITH RECURSIVE words AS (
  SELECT ROW_NUMBER() OVER () AS n, doc_id,
         regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS MATERIALIZED (
  SELECT n, doc_id, list_distinct(CASE WHEN len(ws) > 1
      THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS shingles
  FROM words),
each AS MATERIALIZED (SELECT n, len(shingles) AS size, unnest(shingles) AS s FROM sets),
links AS MATERIALIZED (
  SELECT a.n AS a, b.n AS b FROM each a JOIN each b ON a.s = b.s AND a.n <> b.n
  GROUP BY a.n, b.n, a.size, b.size HAVING 100 * COUNT(*) >= 80 * (a.size + b.size - COUNT(*))),
reach(n, m) AS (SELECT n, n FROM sets UNION SELECT r.n, l.b FROM reach r JOIN links l ON l.a = r.m),
components AS (SELECT r.n, MIN(s.doc_id) AS component_id FROM reach r JOIN sets s ON s.n = r.m GROUP BY r.n)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id,
       COALESCE(doc_id = component_id, FALSE) AS kept
FROM sets JOIN components USING (n)"""


def _clusters_sql() -> str:
    """Three rounds and a last assignment; distances from products, which are whole numbers as doubles."""
    parts = [r"""
kept AS MATERIALIZED (
  SELECT ROW_NUMBER() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
centroids_0 AS MATERIALIZED (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY sha256('1:' || COALESCE(vec_id::VARCHAR, '')), v) - 1 AS INTEGER) AS c, v
  FROM kept QUALIFY c < 16)"""]
    for k in range(4):
        parts.append(f"""
assigned_{k} AS MATERIALIZED (
  SELECT n, vec_id, kept.v, c, list_inner_product(kept.v, kept.v) - 2 * list_inner_product(kept.v, m.v)
                               + list_inner_product(m.v, m.v) AS distance
  FROM kept CROSS JOIN centroids_{k} m QUALIFY ROW_NUMBER() OVER (PARTITION BY n ORDER BY distance, c) = 1)""")
        if k < 3:
            parts.append(f"""
centroids_{k + 1} AS MATERIALIZED (
  SELECT c, COALESCE(means.v, m.v) AS v FROM centroids_{k} m LEFT JOIN (
    SELECT c, list(floor(total / members) ORDER BY i) AS v FROM (
      SELECT c, i, SUM(x) AS total, COUNT(*) AS members
      FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM assigned_{k}) GROUP BY c, i) GROUP BY c) means USING (c))""")
    return "WITH" + ",".join(parts) + """
SELECT vec_id, c AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(SUM(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(SUM(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(m.v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM assigned_3 JOIN centroids_3 m USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_top_k": TOP_K_SQL,
        "op4_chat_format": CHAT_SQL,
        "op8_url_filters": URL_SQL,
        "op9_substring_dedup": REPEATS_SQL,
        "op10_mixing": MIX_SQL,
        "op11_minhash": MINHASH_SQL,
        "op12_centroid_clusters": _clusters_sql(),
    }
