"""Reading and writing records: JSON lines, manifests, documents, dead letters, and tables that are added to but never twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A candidate pair as the extractors write it.
CANDIDATE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("pair_id", "source_doc_id", "source_org", "doc_type", "technical_text", "technical_context", "executive_text", "audience_observed", "alignment_method", "alignment_type", "severity_original", "exec_span_kind", "notes")],
    T.StructField("cited_ids", T.ArrayType(T.StringType())),
    T.StructField("finding_numbers", T.ArrayType(T.IntegerType())),
    T.StructField("needs_llm_verify", T.BooleanType()),
    T.StructField("license", T.StringType()),
    T.StructField("source_url", T.StringType()),
])
#: A flag of a check.
FLAG = T.StructType([T.StructField("check", T.StringType()), T.StructField("level", T.StringType()), T.StructField("message", T.StringType()), T.StructField("evidence", T.ArrayType(T.StringType()))])
#: A verifier's verdict on a pair.
VERDICT = T.StructType([T.StructField("pair_id", T.StringType()), T.StructField("alignment_label", T.StringType()), T.StructField("alignment_confidence", T.DoubleType()), T.StructField("passes_agree", T.BooleanType()), T.StructField("verifier_model", T.StringType()), T.StructField("verifier_reason", T.StringType())])
#: A file of a download manifest.
MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in ("filename", "id", "doc_id", "slug", "dest_filename", "url", "blog_post_url", "detail_url", "pdf_url", "sha256", "status")] + [T.StructField("size", T.LongType())])

_BAD = "_bad"


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Records, and the malformed lines apart. Only ``\\n`` ends a line; blank lines are none."""
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    lines = spark.read.option("lineSep", "\n").text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.col("value"), F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r"))
    good = parsed.where(F.col(f"r.{_BAD}").isNull()).select("r.*").drop(_BAD)
    return good, parsed.where(F.col(f"r.{_BAD}").isNotNull()).select("value")


def read_json_lines_strictly(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records; no record at all is an error, and so is a malformed line: it names the file and the line's beginning, the first of them in order of both."""
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    lines = spark.read.option("lineSep", "\n").text(path).where(F.length(F.trim("value")) > 0).select(F.col("_metadata.file_name").alias("file"), "value")
    bad = lines.where(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})[_BAD].isNotNull())
    n, first = lines.select(F.lit(1)).limit(1).count(), bad.agg(F.min(F.struct("file", F.left("value", F.lit(80)).alias("value")))).first()[0]
    if first is not None:
        raise ValueError(f"malformed line in {first['file']}: {first['value']}")
    if not n:
        raise ValueError(f"no records in {path}")
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def search_hits(pages: DataFrame, id: str, items: str, wanted: str) -> DataFrame:
    """Hits of a paged search, ``pages(page, hits)`` with an array of structs each: every id once, as the first page that has it gives it, if its ``items`` hold the one wanted."""
    hits = pages.select("page", F.posexplode("hits").alias("place", "h"))
    first = hits.groupBy(F.col(f"h.{id}").alias("_id")).agg(F.min_by("h", F.struct("page", "place")).alias("h"))
    return first.select("h.*").where(F.array_contains(items, wanted))


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """Entries of a file that holds a JSON array of objects, or an object of objects by name; what is neither gives none."""
    text = spark.read.text(path, wholetext=True)
    listed, named = F.from_json("value", T.ArrayType(schema)), F.map_values(F.from_json("value", T.MapType(T.StringType(), schema)))
    is_list = F.trim("value").startswith("[")
    return text.select(F.explode(F.coalesce(F.when(is_list, listed), named)).alias("e")).select("e.*")


def read_documents(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(``doc``, ``parts``, ``text``): a row per file; the name without extension, and its parts between double underscores."""
    rows = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), F.col("value").alias("text"))
    doc = F.regexp_replace("f", r"\.[^.]*$", "")
    return rows.select(doc.alias("doc"), F.split(doc, "__").alias("parts"), "text")


def split_dead_letters(rows: DataFrame, reason: str = "drop_reason") -> tuple[DataFrame, DataFrame]:
    """What goes on, and what goes to the dead letters with its reason."""
    return rows.where(F.col(reason).isNull()).drop(reason), rows.where(F.col(reason).isNotNull())


def write_dead_letters(rows: DataFrame, path: str, key: str, reason: str = "drop_reason") -> None:
    rows.select(F.col(key).cast("string").alias("key"), reason).write.mode("append").option("sep", "\t").csv(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """One file of the named columns, for small tables."""
    rows.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_once(rows: DataFrame, path: str, key: str) -> None:
    """Add the rows whose key is not there yet; a second run adds nothing."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti").select(rows.columns)
    fresh.write.mode("append").parquet(path)


def script_safe_json(value: Column) -> Column:
    """JSON that can stand in markup: ``<``, ``>`` and ``&`` as escapes, which parsers read back."""
    out = F.to_json(value)
    for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def short_keys(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """A JSON object per row with renamed keys; null and blank values are left out."""
    fields = [F.nullif(F.col(old).cast("string"), F.lit("")).alias(new) for old, new in names.items()]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("value"))


def write_index(postings: DataFrame, vectors: DataFrame | None, path: str, buckets: int = 64) -> None:
    """The retrieval tables: postings in folders by a hash of the term, so that a query reads only its terms' folders; and vectors."""
    postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def needs_ocr(pages: DataFrame, doc: str = "doc", chars: str = "n_chars", least: int = 200, share: float = 0.3) -> DataFrame:
    """(doc, ``ocr``): whether more than ``share`` of a document's pages have fewer than ``least`` characters."""
    return pages.groupBy(doc).agg((F.avg((F.col(chars) < least).cast("int")) > share).alias("ocr"))


def is_garbled(text: Column) -> Column:
    """Fewer than 20 words, or fewer than 3 English function words, in the first 3000 characters."""
    head = F.lower(F.left(text, F.lit(3000)))
    return (F.regexp_count(head, F.lit(r"\S+")) < 20) | (F.regexp_count(head, F.lit(r"\b(?:the|of|and|to|in|a|is|that|for|with)\b")) < 3)


def best_text(candidates: list[tuple[str, Column]]) -> Column:
    """``struct<via, text>`` of the first parser whose text is there and not garbled; null if none is."""
    return F.coalesce(*[F.when(text.isNotNull() & ~is_garbled(text), F.struct(F.lit(name).alias("via"), text.alias("text"))) for name, text in candidates])
