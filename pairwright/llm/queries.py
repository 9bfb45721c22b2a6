"""The queries of this subpackage, as the driver runs them: name -> (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bagminhash, decontam, fourier, infill, langid, licences, linededup, mixing, paragraphs, quality, urltree, warc, yinyang
from .store import stored


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = paragraphs.repeats(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    n = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    return found.select(F.col("id").alias("doc_id"), n.alias("n_repeated"), (F.size("spans") > 0).alias("repeats"), spans.alias("spans"))


URL_RULES = tuple(urltree.UrlRule.of(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = urltree.judge(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", *[f"url_filter.{n}" for n in ("host", "path", "rule", "verdict")])


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = bagminhash.classes(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id")


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "mix.n_tokens", "mix.epoch", "mix.block", F.round("mix.source_weight", 6).alias("source_weight"), F.round("mix.position", 9).alias("position"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = linededup.dedup(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "lines.n_lines", "lines.n_removed", F.array_join(F.col("lines.removed").cast("array<string>"), ",").alias("removed"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    q = quality.judge(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *[f"quality.{n}" for n in names])


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.fit(docs.where(part.isin(0, 1)), docs.where(part == 3))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select(F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{folder}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.licences(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.array_join("families", ",").alias("families"), F.col("n_notices").cast("bigint").alias("n_notices"), "n_unknown")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    found = decontam.contamination(read("documents"), read("benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    found = yinyang.clusters(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    stats = stored(fourier.statistics(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")), "statistics")
    part = F.crc32(F.col("id").cast("string")) % 5
    learn = fourier.labelled(stats.where(part != 0), spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "quality")
    model = fourier.fit(learn.where(part != 4), learn.where(part == 4))
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    return fourier.scored(stats, model).select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    done = infill.infill(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    output = F.col("fim.output")
    return done.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(infill.restored(output, F.col("fim.form")), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_warc": op2_warc,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_licence_scan": op9_licence_scan,
    "op10_decontamination": op10_decontamination,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}

_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

_OP8 = rf"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM w),
p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t),
g AS (SELECT r, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
d AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g WHERE gram IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) AS x(k) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(full_lines) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts,
             length(regexp_replace(text, '[^A-ZÄÖÜÉÈÊÇÑÓÍÁÚ]', '', 'g')) AS n_upper,
             len(list_filter(words, lambda x: list_contains([{_STOPS}], lower(regexp_replace(x, '[.,;:!?]', '', 'g'))))) AS n_stop_words,
             len(list_filter(words, lambda x: regexp_matches(x, '\pL'))) AS n_letter_words,
             len(list_filter(full_lines, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullet_lines,
             len(list_filter(full_lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) AS n_ellipsis_lines
      FROM t LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2.0 * n_words AND 20.0 * n_words AND n_symbols / n_words <= 0.1 AND n_shouts / n_words <= 0.3
       AND n_upper / word_chars <= 0.5 AND n_stop_words / n_words >= 0.05 AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5
       AND n_letter_words / n_words >= 0.6 AND coalesce(n_bullet_lines / nullif(n_lines, 0), 0) <= 0.9
       AND coalesce(n_ellipsis_lines / nullif(n_lines, 0), 0) <= 0.3 AS kept
FROM b
"""

_OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""

_OP7 = """
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
c AS (SELECT doc_id, line, trim(t, ' ' || chr(9) || chr(13)) AS t FROM l),
u AS (SELECT t, length(t) AS n, CASE WHEN length(t) >= 1000 THEN 4 WHEN length(t) >= 30 THEN 2 ELSE 1 END AS k FROM c WHERE length(t) >= 9 GROUP BY t),
p AS (SELECT a.t AS x, b.t AS y FROM u a JOIN u b ON b.n BETWEEN a.n AND a.n + a.k WHERE a.t <> b.t
      AND CASE a.k WHEN 1 THEN left(a.t, a.n // 2) = left(b.t, a.n // 2) OR right(a.t, a.n - a.n // 2) = right(b.t, a.n - a.n // 2)
          WHEN 2 THEN left(a.t, a.n // 3 - 2) = left(b.t, a.n // 3 - 2) OR right(a.t, a.n // 3 - 2) = right(b.t, a.n // 3 - 2) OR contains(b.t, substr(a.t, a.n // 3 + 3, a.n // 3 - 4))
          ELSE true END AND levenshtein(a.t, b.t) <= a.k),
e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
reach AS (SELECT x, x AS y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
class AS (SELECT x AS t, min(y) AS class FROM reach GROUP BY x),
o AS (SELECT doc_id, line, coalesce(class, t) AS class FROM c LEFT JOIN class USING (t) WHERE t <> ''),
k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY class ORDER BY doc_id, line) AS r FROM o),
g AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM k WHERE r > 1 GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN g USING (doc_id)
"""

_OP10 = r"""
WITH words AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS phrase
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
          FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, s.n, item_id FROM spots s JOIN windows USING (n, phrase)),
covered AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hits), (SELECT unnest(range(10)) AS k) WHERE k < n GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""



def _op11_sql(rounds: int = 3) -> str:
    """Plain rounds of assignment and means; centroids of round 0 are the vectors with the least hashes."""
    near = lambda c: f"""SELECT vec_id, x, arg_min(cluster, struct_pack(d := d, n := cluster)) AS cluster, min(d) AS distance
        FROM (SELECT v.vec_id, v.x, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS d FROM v, {c} c) GROUP BY ALL"""  # noqa: E731
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near(f'c{r}')})")
        steps.append(f"""s{r} AS (SELECT cluster, i, CAST(sum(e) AS BIGINT) AS total, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY ALL)""")
        steps.append(f"""m{r} AS (SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY cluster)""")
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS cluster, x FROM (SELECT * FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)),
{", ".join(steps)},
f AS MATERIALIZED ({near(f"c{rounds}")})
SELECT vec_id, f.cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM f JOIN c{rounds} c ON c.cluster = f.cluster
"""


_OP13 = r"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS b, array_to_string(u[hi + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

ORACLE: dict[str, str] = {
    "op11_centroid_clustering": _op11_sql(),
    "op13_fill_in_middle": _OP13,
    "op2_warc": _OP2,
    "op7_line_dedup": _OP7,
    "op10_decontamination": _OP10,
    "op8_quality_rules": _OP8,
}
