"""Queries of sources: strict scans, paged searches, every format and audience, streams of events and of judged pairs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import checks
from ..sources import records
from ..sources.checkpoints import shared_folder
from ..streaming import incremental
from .pairs import TALK_PAIRS_SQL, table, talk_pairs

Query = Callable[[SparkSession, str], DataFrame]


def strict_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as JSON lines, read strictly: whole, with one line spoilt, and with none."""
    place, labels = f"{shared_folder(spark)}/strict-{uuid.uuid4().hex}", table(spark, folder, "labels")
    labels.write.json(f"{place}/good")
    line, least = F.to_json(F.struct("doc_id", "quality")), labels.agg(F.min("doc_id")).first()[0]
    labels.select(F.when(F.col("doc_id") == least, F.concat(F.lit("{broken "), F.col("doc_id"))).otherwise(line).alias("value")).write.text(f"{place}/spoilt")
    labels.limit(0).write.json(f"{place}/none")
    schema, rows = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType())]), []
    for name in ("good", "spoilt", "none"):
        try:
            rows.append((name, f"{records.read_json_lines_strictly(spark, f'{place}/{name}', schema).where('doc_id is not null').count()} records"))
        except ValueError as error:
            rows.append((name, str(error).rsplit(": ", 1)[-1] if "malformed" in str(error) else "no records"))
    return spark.createDataFrame(rows, "what string, result string")


def paged_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as hits of a search, in pages of 100 of which each repeats ten of the one before; those with a third line."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("1.0"), F.col("l_linenumber"))).alias("items"))
    hits = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.struct(F.col("o_orderkey").alias("id"), "items", F.col("o_orderstatus").alias("status")).alias("h"))
    page = F.floor(F.col("h.id") / 100)
    placed = hits.select(F.explode(F.when(F.col("h.id") % 100 >= 90, F.array(page, page + 1)).otherwise(F.array(page))).alias("page"), "h")
    pages = placed.groupBy("page").agg(F.sort_array(F.collect_list("h")).alias("hits"))
    return records.search_hits(pages, "id", "items", "1.03").select("id", "status")


def format_lints(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn against every format and every audience; turns of every third conversation have their lines as bullets."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n- ")))).otherwise(F.col("text")).alias("text"))
    asked = [(c, None) for c in checks.CONTRACTS] + [(None, a) for a in checks.AUDIENCES]
    each = F.explode(F.array(*[F.struct(F.lit(c).cast("string").alias("contract"), F.lit(a).cast("string").alias("audience")) for c, a in asked])).alias("x")
    rows = turns.select("conv_id", "turn", "text", each).select("conv_id", "turn", "x.*", F.explode(checks.format_lint(F.col("text"), F.col("x.contract"), F.col("x.audience"))).alias("f"))
    return rows.groupBy(F.coalesce("contract", F.lit("")).alias("contract"), F.coalesce("audience", F.lit("")).alias("audience"), "f.level").agg(F.count("*").alias("n_flags"), F.sum(F.length(F.array_join("f.evidence", "|"))).alias("n_chars"))


def _streamed(spark: SparkSession, rows: DataFrame, what: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The result of a stream over files of ``rows``, run to its end."""
    place = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    for part in range(2):
        rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(2)) == part).write.mode("append").parquet(f"{place}/in")
    out = step(incremental.stream_files(spark, f"{place}/in", rows.schema, files_per_trigger=1000))
    out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out")


def judged_as_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Flags of length and jargon of the answers in talks, as their files arrive."""
    pairs = talk_pairs(spark, folder).select(F.concat_ws("/", "conv_id", "turn").alias("pair_id"), "draft_text")
    judge = lambda rows: rows.withColumn("flags", checks.format_lint(F.col("draft_text"), F.lit("email"), F.lit("management"))).withColumn("ok", ~F.exists("flags", lambda f: f["level"] == "fail"))
    return _streamed(spark, pairs, "judged", lambda rows: incremental.judged_stream(rows, judge).select("pair_id", "ok", "level"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by kind and hour, in a stream with a watermark that is later than all of them, so that every window closes."""
    events = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    last = events.agg(F.max("ts")).first()[0]
    closing = spark.createDataFrame([(last,)], "ts timestamp").select((F.col("ts") + F.expr("interval 3 days")).alias("ts"), F.lit("closing").alias("event_type"))
    out = _streamed(spark, events.unionByName(closing.select("ts", "event_type")), "windows", lambda rows: incremental.windowed_counts(rows, "ts", "event_type", "1 hour", "2 days"))
    return out.where("event_type <> 'closing'").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


QUERIES: dict[str, Query] = {f.__name__: f for f in (strict_lines, paged_hits, format_lints, judged_as_stream, event_windows)}

_JARGON = "[" + ", ".join("[" + ", ".join(f"'{t}'" for t in sorted(a.jargon)) + "]" for a in checks.AUDIENCES.values() if a.jargon) + "]"
ORACLE: dict[str, str] = {
    "strict_lines": "SELECT 'good' AS what, count(*) || ' records' AS result FROM labels UNION ALL SELECT 'spoilt', '{broken ' || min(doc_id) FROM labels UNION ALL SELECT 'none', 'no records'",
    "paged_hits": "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)",
    "format_lints": r"""WITH t AS (SELECT CASE WHEN conv_id % 3 = 0 THEN '- ' || replace(text, chr(10), chr(10) || '- ') ELSE text END AS text FROM conversations), w AS (SELECT text, len(regexp_extract_all(text, '\S+')) AS n, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^[-•*]')) AS b FROM t),
        f AS (SELECT 'email' AS contract, '' AS audience, 'fail' AS level, n || ' words' AS e FROM w WHERE n > 150 UNION ALL SELECT 'one_pager', '', 'fail', n || ' words' FROM w WHERE n > 180 UNION ALL SELECT 'slide', '', 'fail', len(b) || ' bullets' FROM w WHERE len(b) > 0 AND len(b) <> 3
          UNION ALL SELECT 'slide', '', 'fail', trim(x) FROM (SELECT unnest(b) AS x FROM w) WHERE len(regexp_extract_all(regexp_replace(x, '^[-•* ]+', ''), '\S+')) > 20
          UNION ALL SELECT '', a, 'warn', array_to_string(h, '|') FROM (SELECT a, list_filter(j, lambda x: contains(lower(text), x)) AS h FROM w, (SELECT unnest(["""
    + ", ".join(f"'{k}'" for k, a in checks.AUDIENCES.items() if a.jargon) + "]) AS a, unnest(" + _JARGON + r""") AS j)) WHERE len(h) > 0)
        SELECT contract, audience, level, count(*) AS n_flags, CAST(sum(length(e)) AS BIGINT) AS n_chars FROM f GROUP BY ALL""",
    "judged_as_stream": rf"""WITH {TALK_PAIRS_SQL}, p AS (SELECT conv_id || '/' || turn AS pair_id, len(regexp_extract_all(draft_text, '\S+')) > 150 AS long, len(list_filter([{", ".join(f"'{t}'" for t in checks.AUDIENCES["management"].jargon)}], lambda x: contains(lower(draft_text), x))) > 0 AS jargon FROM talk_pairs)
        SELECT pair_id, NOT long AS ok, 'fail' AS level FROM p WHERE long UNION ALL SELECT pair_id, NOT long, 'warn' FROM p WHERE jargon UNION ALL SELECT pair_id, true, NULL FROM p WHERE NOT long AND NOT jargon""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
}
