"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopelake.llm.common import table


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of another length than the most frequent one take no part either: they have no inner product with the others."""
    from scopelake.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).drop("scored")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopelake.llm.secrets import scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["rank"] <= 3)
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("found")).alias("spans"),
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopelake.llm.chat import digests, formatted

    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return digests(formatted(said.unionByName(more)))


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopelake.llm.warc import archive

    return archive(table(spark, sf_dir, "pages"))[1]


def op5_mix_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopelake.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopelake.llm.token_files import encode_to_files

    return encode_to_files(table(spark, sf_dir, "documents"))[1]


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopelake.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopelake.llm.classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopelake.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopelake.llm.quality_rules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopelake.llm.codes import compress

    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopelake.llm.online import pack_online

    return pack_online(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scopelake.llm.negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_top_k, op2_secret_scans, op3_chat_formatting, op4_warc_segments, op5_mix_to_target_weights, op6_token_id_output, op7_simhash_near_dedup, op8_quality_classifier, op9_best_fit_packing, op10_quality_rules, op11_vector_codes, op12_online_packing, op13_hard_negatives, pipeline)}


TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""

HARD = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5"""


def _codes_sql(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """The rounds one after another: b0 are the first codebooks, b1, b2 those after each round, as rows of (part, entry, values)."""
    steps = f"""
WITH k AS (
  SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
x AS MATERIALIZED (SELECT k, part, v[1 + part * len(v) // {parts} : (part + 1) * len(v) // {parts}] AS v FROM k, range({parts}) r(part)),
n AS (SELECT k, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM k QUALIFY entry < {entries}),
b0 AS (SELECT part, entry, v FROM x JOIN n USING (k))"""
    nearest = lambda b: f"SELECT k, x.part, x.v, arg_min(entry, {{'d': d, 'e': entry}}) AS entry, min(d) AS d FROM (SELECT k, x.part, x.v, entry, list_sum(list_transform(list_zip(x.v, {b}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM x JOIN {b} USING (part)) x GROUP BY ALL"
    for r in range(rounds):
        steps += f""",
a{r} AS MATERIALIZED ({nearest(f"b{r}")}),
u{r} AS (SELECT part, entry, list(CAST(floor(s / c) AS BIGINT) ORDER BY i) AS v FROM (SELECT part, entry, i, sum(v[i])::DOUBLE AS s, count(*) AS c FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS (SELECT part, entry, coalesce(u{r}.v, b{r}.v) AS v FROM b{r} LEFT JOIN u{r} USING (part, entry))"""
    return f"""{steps},
f AS ({nearest(f"b{rounds}")}),
c AS (SELECT k, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY k),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (k), h"""


CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, role || text AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length(body) + 3 * length(body) - length(replace(body, '<', '')) - length(replace(body, '[', '')) - length(replace(body, '\', ''))) AS BIGINT) AS formatted_chars,
  false AS rewrites, CAST(0 AS BIGINT) AS unlocated
FROM e GROUP BY conv_id"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND first IS DISTINCT FROM page_id AS again FROM o)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r"""

RULES = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT k, i FROM p QUALIFY count(*) OVER (PARTITION BY k, tri) > 1),
r AS (SELECT k, count(DISTINCT i + o) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) AS o(o) GROUP BY k),
f AS (
  SELECT d.k, doc_id, text, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM d JOIN w USING (k) LEFT JOIN r USING (k)),
g AS (
  SELECT *, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '\p{Lu}')) AS upper,
    len(regexp_extract_all(text, '(?m)(\.\.\.|…)[ \t\r]*$')) AS dots, len(regexp_extract_all(text, '(?m)^[ \t]*[-*•]')) AS bullets,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * letters < 6 * word_chars
    OR 2 * upper > letters OR 10 * dots > 3 * greatest(n_lines, 1) OR 10 * bullets > 9 * greatest(n_lines, 1)) AS kept FROM g"""


def _secrets_sql() -> str:
    """Gaps and matches of each pattern in turn; RE2 has no look-around, so random tokens are taken from whole runs."""
    from scopelake.llm.secrets import ACCESS, ACCOUNT, ASSIGN, ENDPOINT, KINDS, SCOPE

    plain = lambda p: p.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace("'", "''")
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": "[0-9a-f]{24,}", "account": ACCOUNT, "random": "[A-Za-z0-9+/_]+={0,2}", "endpoint": ENDPOINT}
    every = " UNION ALL ".join(
        f"SELECT k, '{kind}' AS raw, string_split_regex(text, '{plain(p)}') AS g, regexp_extract_all(text, '{plain(p)}') AS m, "
        f"{f"regexp_extract_all(text, '{plain(p)}', 2)" if kind == 'assign' else 'NULL::VARCHAR[]'} AS v FROM d"
        for kind, p in patterns.items()
    )
    rank = "list_position([" + ", ".join(f"'{k}'" for k in KINDS) + "], kind)"
    near = lambda part: (
        f"coalesce(s - max(CASE WHEN {part} THEN e END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {SCOPE}, false) "
        f"OR coalesce(min(CASE WHEN {part} THEN s END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - e <= {SCOPE}, false)"
    )
    identifier, secret = "kind IN ('access', 'account', 'short_access')", "kind IN ('assign', 'hex', 'random', 'short_assign')"
    shown = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, " + rank + ")"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
a AS ({every}),
u AS (SELECT k, raw, unnest(range(1, len(m) + 1)) AS n, g, m, v FROM a WHERE len(m) > 0),
x AS (SELECT k, raw, n, length(g[n]) AS gap, m[n] AS m, v[n] AS v FROM u),
p AS (SELECT *, sum(gap + length(m)) OVER (PARTITION BY k, raw ORDER BY n) - length(m) AS s FROM x),
q AS (SELECT k, raw, v, CAST(s AS BIGINT) AS s, CASE WHEN raw = 'random' THEN regexp_extract(m, '^[A-Za-z0-9+/]*={{0,2}}') ELSE m END AS m FROM p),
r AS (
  SELECT k, s, s + length(m) AS e, CASE WHEN raw = 'assign' AND length(v) < 6 THEN 'short_assign' WHEN raw = 'access' AND length(m) < 20 THEN 'short_access' ELSE raw END AS kind FROM q
  WHERE raw <> 'random' OR (length(rtrim(m, '=')) >= 16 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]'))),
l AS (SELECT *, {near(identifier)} AS near_id, {near(secret)} AS near_secret FROM r WINDOW w AS (PARTITION BY k ORDER BY s, e, kind)),
f AS (
  SELECT * FROM l WHERE CASE WHEN kind IN ('account', 'short_access') THEN near_secret WHEN kind IN ('short_assign', 'random') THEN near_id WHEN kind = 'endpoint' THEN near_id AND near_secret ELSE true END)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce({shown} FILTER (kind IN ('assign', 'access', 'hex')), '')) AS base_sha256, coalesce({shown}, '') AS spans
FROM d LEFT JOIN f USING (k) GROUP BY k, doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express: not tokenizers, models, fingerprints, look-around or dynamic programmes."""
    return {"op1_exact_top_k": TOP_K, "op2_secret_scans": _secrets_sql(), "op3_chat_formatting": CHAT, "op4_warc_segments": WARC, "op10_quality_rules": RULES, "op11_vector_codes": _codes_sql(), "op13_hard_negatives": HARD}
