"""Views of the driver's tables as pairs of a source and a draft."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Tables of texts: little in bytes for the work that they make.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the driver's. One of texts in fewer splits than there are cores is dealt out to all of them; a large one is read as it lies."""
    rows, cores = spark.read.parquet(f"{folder}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in TEXTS and rows.rdd.getNumPartitions() < cores else rows


def finding_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Security findings made from orders and their line items, with drafts that change one thing by ``variant``."""
    counts = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").alias("doc_id"))
    rows = orders.join(counts, F.col("pair_id") == F.col("l_orderkey")).drop("l_orderkey")
    key = F.col("pair_id").cast("string")
    rows = rows.withColumn("variant", (F.col("pair_id") % 10).cast("int"))
    rows = rows.withColumn("sev", F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (F.col("pair_id") % 4 + 1).cast("int")))
    rows = rows.withColumn("cve", F.concat(F.lit("CVE-2024-"), F.when(F.length(key) < 5, F.lpad(key, 5, "0")).otherwise(key)))
    rows = rows.withColumn("hosts", (F.col("n_lines") + 10).cast("string"))
    v = F.col("variant")

    def text(sev, name, count, address, verb, condition, ending):
        return F.concat(sev, name, F.lit(" affects "), count, F.lit(" hosts at "), address, F.lit(". An attacker "), verb, F.lit(" records"), condition, F.lit(". "), ending)

    severity = lambda s: F.concat(F.lit("Severity "), s, F.lit(". "))
    only, none = F.lit(" only if the debug interface is enabled"), F.lit("There is no evidence of exploitation.")
    source = text(severity(F.col("sev")), F.col("cve"), F.col("hosts"), F.lit("10.2.3.4"), F.lit("could read"), only, none)
    draft = text(
        F.when(v == 3, F.lit("Severity low. ")).when(v == 4, F.lit("Severity critical. ")).when(v == 5, F.lit("")).otherwise(severity(F.col("sev"))),
        F.when(v == 1, F.lit("One flaw")).otherwise(F.col("cve")),
        F.when(v == 2, F.lit("several")).otherwise(F.col("hosts")),
        F.when(v == 9, F.lit("203.0.113.7")).otherwise(F.lit("10.2.3.4")),
        F.when(v == 7, F.lit("allows reading")).otherwise(F.lit("could read")),
        F.when(v == 6, F.lit("")).otherwise(only),
        F.when(v == 8, F.lit("Attackers accessed the records.")).otherwise(none),
    )
    # The checks are heavy and the rows light: spread them over all cores, whatever their size in bytes.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("pair_id", "doc_id", "variant", "sev", source.alias("source_text"), draft.alias("draft_text"))


#: The same view in SQL.
FINDING_PAIRS_SQL = """
finding_pairs AS (
  SELECT pair_id, doc_id, variant, sev,
         'Severity ' || sev || '. ' || cve || ' affects ' || hosts || ' hosts at 10.2.3.4. An attacker could read records only if the debug interface is enabled. There is no evidence of exploitation.' AS source_text,
         CASE variant WHEN 3 THEN 'Severity low. ' WHEN 4 THEN 'Severity critical. ' WHEN 5 THEN '' ELSE 'Severity ' || sev || '. ' END
         || CASE variant WHEN 1 THEN 'One flaw' ELSE cve END || ' affects ' || CASE variant WHEN 2 THEN 'several' ELSE hosts END
         || ' hosts at ' || CASE variant WHEN 9 THEN '203.0.113.7' ELSE '10.2.3.4' END || '. An attacker '
         || CASE variant WHEN 7 THEN 'allows reading' ELSE 'could read' END || ' records'
         || CASE variant WHEN 6 THEN '' ELSE ' only if the debug interface is enabled' END || '. '
         || CASE variant WHEN 8 THEN 'Attackers accessed the records.' ELSE 'There is no evidence of exploitation.' END AS draft_text
  FROM (SELECT o_orderkey AS pair_id, o_custkey AS doc_id, CAST(o_orderkey % 10 AS INTEGER) AS variant,
               CASE o_orderkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS sev,
               'CVE-2024-' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(5, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS cve,
               CAST(n + 10 AS VARCHAR) AS hosts
        FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey))
"""


def talk_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the assistant turn that follows, as natural pairs."""
    turns = table(spark, folder, "conversations")
    order = W.partitionBy("conv_id").orderBy("turn")
    following = turns.withColumns({"next_role": F.lead("role").over(order), "draft_text": F.lead("text").over(order)})
    return following.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("source_text"), "draft_text")


TALK_PAIRS_SQL = """
talk_pairs AS (
  SELECT conv_id, turn, text AS source_text, draft_text
  FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS draft_text FROM conversations)
  WHERE role = 'user' AND next_role = 'assistant')
"""
