"""Queries of how drafts are written, of errors beside the recall of their checks, of all genre checks, of parsed documents, of harvested rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..operators import analytics, checks, composite, evidence, genre, harvest, retrieve
from ..sources.checkpoints import stored
from . import check_queries, genre_queries
from .pairs import FINDING_PAIRS_SQL, finding_pairs, table

Query = Callable[[SparkSession, str], DataFrame]
_OPENINGS = ("The web application keeps data. ", "A local attacker with access to the host may act. ", "Successful exploitation of this vulnerability could be costly. We recommend a fix of three issues. ", "No issue of high-severity is known at this time and the code is mature. ")
_REGISTERS = ("practitioner", "management", "technical_leadership", "regulatory", "customer")


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of findings with openings, figures, registers and bodies by number, and every sixth as a whole document."""
    p = F.col("pair_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(p / 7) % n + 1).cast("int"))
    figure = (p % 7 * 10 + 20).cast("string")
    return finding_pairs(spark, folder).select(
        "pair_id", F.concat("source_text", F.lit(" The service stores "), figure, F.lit(" records."), F.when(p % 3 == 0, F.lit(" An XSS flaw was found.")).otherwise(F.lit(""))).alias("source_text"),
        F.concat(pick(_OPENINGS, 4), F.col("draft_text"), F.when(p % 2 == 0, F.concat(F.lit(" It keeps "), figure, F.lit(" records apart from xss."))).otherwise(F.lit(""))).alias("draft_text"),
        pick(_REGISTERS, 5).alias("register"), F.initcap("sev").alias("severity"), F.when(p % 3 == 1, "cisa").otherwise("other").alias("org"), (p % 6 == 0).alias("doc_level"),
    )


def corpus_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Each measure of the drafts: how many pairs it applies to, and for how many it holds."""
    return evidence.evidence(_written(spark, folder))


def loss_and_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How often the drafts of three models fail each check, beside the check's recall of planted errors."""
    pairs = finding_pairs(spark, folder).withColumn("target", check_queries.aimed_check(F.col("variant")))
    fails = lambda flags: F.filter(flags, lambda f: f["level"] == "fail")
    judged = checks.judge(pairs, target="target", base="base_flags").select("pair_id", "variant", "target", F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"), "flags", "base_flags")
    # Judged once, for the losses of the drafts and for what is planted in them; the texts stay behind.
    judged = stored(judged.select("pair_id", "variant", "target", "model", F.array_distinct(F.transform(fails(F.col("flags")), lambda f: f["check"])).alias("failed"), (F.size(fails(F.col("base_flags"))) > 0).alias("base_failed")), "judged")
    items = judged.select("model", F.explode(F.array(*[F.struct(F.lit(c).alias("error"), F.array_contains("failed", c).alias("lost")) for c in checks.CHECKS])).alias("x")).select("model", "x.*")
    drafts = F.array(F.struct(F.lit(True).alias("base"), F.col("base_failed").alias("failed")), F.struct(F.lit(False).alias("base"), F.expr("array_contains(failed, target)").alias("failed")))
    planted = analytics.planted_recall(judged.where("target is not null").select("pair_id", "variant", "target", F.explode(drafts).alias("d")).select("pair_id", "variant", "target", "d.*"), "pair_id", ["variant", "target"])
    recall = planted.groupBy(F.col("target").alias("error")).agg(F.round(F.sum("n_found") / F.sum("n"), 6).alias("recall"))
    return evidence.loss_and_recall(items, recall)


def genre_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """How many outcomes of each kind the three genre checks have together; of a published genre they fail, of another they warn."""
    questions, jargon, constants = genre_queries.lists(spark)
    out = genre.genre_checks(genre_queries.drafts(spark, folder), genre_queries.genres(spark), questions, jargon, constants)
    return out.groupBy("check", "outcome").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_drafts"))


def document_tests(spark: SparkSession, folder: str) -> DataFrame:
    """The named tests of parsed documents, each document as a page for every 3000 characters, with a table by its number and headings for every third."""
    docs = table(spark, folder, "documents")
    k = F.col("doc_id")
    text = F.concat(F.when(k % 3 == 0, F.lit("# Executive Summary\n")).otherwise(F.lit("")), F.coalesce("text", F.lit("")), F.when(k % 3 <= 1, F.lit("\n## Results\nThe risk is low.")).otherwise(F.lit("")), F.when(k % 50 == 0, F.lit("�" * 40)).otherwise(F.lit("")))
    poor = F.struct((k % 4).cast("int").alias("num_cols"), F.lit(5).alias("num_rows"), (k % 10 / 10).alias("empty_cell_frac"))
    tests = checks.document_checks(text, F.floor(F.length(text) / 3000) + 1, F.when(k % 5 == 0, F.array().cast("array<struct<num_cols:int,num_rows:int,empty_cell_frac:double>>")).otherwise(F.array(poor)))
    return docs.select("doc_id", *[v.alias(n) for n, v in tests.items()])


#: A letter of a profile, or one of the two beyond ASCII that have such a letter in lower case.
_HAS_LETTER = "[A-Za-z\u0130\u212a]"


def nearest_in_document(spark: SparkSession, folder: str) -> DataFrame:
    """For every other line of a document its five nearest among the rest, by letters: joined within the document, not with the whole table."""
    lines = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("n", "t")).where(F.col("t").rlike(_HAS_LETTER))
    lines = retrieve.normalised(lines.select("doc", "n", models.letter_profile(F.col("t")).alias("v")), "v")
    near = composite.nearest_within(lines.where("n % 2 = 0").withColumnRenamed("n", "sentence"), lines.where("n % 2 = 1").withColumnRenamed("n", "target"), k=5)
    return near.select("doc", "sentence", "target", "cosine", "rank")


def adapted_harvest(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as three kinds of harvested rows, brought under the schema of candidates, and register material."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("k"), "text", "lang", "source")
    kind = F.element_at(F.array(*map(F.lit, ("csrb", "gao", "oig"))), (F.col("k") % 3 + 1).cast("int"))
    some = lambda keep, value: F.when(keep, value)
    board = docs.where("k % 4 = 0").select(
        F.concat(F.lit("b"), "k").alias("pair_id"), kind.alias("source"), F.concat(F.lit("Report of "), some(F.col("k") % 8 == 0, (2000 + F.col("k") % 25).cast("string")).alias("y"), F.lit(" on "), "source").alias("t1"), F.concat(F.lit("Report on "), "source").alias("t2"),
        some(F.col("k") % 3 == 0, F.col("lang")).alias("agency"), F.concat(F.lit("http://x/2019/"), "k").alias("source_url"), F.col("text").alias("technical_text"), some(F.col("k") % 16 == 0, F.lit("board says")).alias("board_text"), F.lit("all say").alias("executive_text"), F.lit(None).cast("string").alias("note"),
    ).withColumn("report_title", F.coalesce("t1", "t2"))
    advisories = docs.where("k % 4 = 1").select(F.concat(F.lit("GHSA-"), "k").alias("ghsa_id"), F.col("source").alias("package"), F.upper(F.element_at(F.array(*map(F.lit, ("low", "high"))), (F.col("k") % 2 + 1).cast("int"))).alias("severity"), F.col("text").alias("technical_text"), F.left("text", F.lit(50)).alias("impact_text"), F.lit("").alias("source_url"), F.col("lang").alias("vuln_class"))
    dates = docs.where("k % 8 = 1").select(F.concat(F.lit("GHSA-"), "k").alias("ghsa_id"), F.concat((2015 + F.col("k") % 9).cast("string"), F.lit("-01-01")).alias("published"))
    shape = lambda rows, name: rows.select(F.lit(name).alias("what"), F.col("pair_id").alias("id"), "source_doc_id", "source_org", F.concat_ws("|", "doc_type", "technical_context", "audience_observed", "severity_original", "license", "notes").alias("facts"), F.md5(F.concat_ws("|", "technical_text", "executive_text")).alias("texts_md5"))
    rest = docs.where("k % 4 >= 2")
    judged = rest.where("k % 4 = 2").select("text", some(F.col("k") % 3 == 0, F.lit("story")).alias("mode"), F.col("lang").alias("concept"), "source", F.lit(None).cast("string").alias("license"), (F.col("k") % 5).alias("score"), F.when(F.col("k") % 7 == 0, "drop").otherwise("keep").alias("verdict"))
    filings = rest.where("k % 8 = 3").select("text", F.col("lang").alias("concept"), "source")
    letters = rest.where("k % 8 = 7").select(F.col("k").alias("id"), "text", F.col("lang").alias("concept"), "source")
    verdicts = rest.where("k % 16 = 7").select(F.col("k").alias("id"), F.when(F.col("k") % 3 == 0, "drop").otherwise("keep").alias("verdict"))
    register = harvest.register_material(judged, filings, letters, verdicts)
    told = register.select(F.lit("register").alias("what"), F.col("kind").alias("id"), F.col("concept").alias("source_doc_id"), F.col("source").alias("source_org"), F.concat_ws("|", "license", F.col("score").cast("int")).alias("facts"), F.md5("text").alias("texts_md5"))
    return shape(harvest.board_candidates(board), "board").unionByName(shape(harvest.advisory_candidates(advisories, dates), "advisory")).unionByName(told)


QUERIES: dict[str, Query] = {f.__name__: f for f in (corpus_evidence, loss_and_recall, genre_outcomes, document_tests, nearest_in_document, adapted_harvest)}

_PICK = lambda values, n: "CASE (pair_id // 7) % {} {} END".format(n, " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)))
_WRITTEN = f"""written AS (SELECT pair_id, source_text || ' The service stores ' || (pair_id % 7 * 10 + 20) || ' records.' || CASE WHEN pair_id % 3 = 0 THEN ' An XSS flaw was found.' ELSE '' END AS s,
  {_PICK(_OPENINGS, 4)} || draft_text || CASE WHEN pair_id % 2 = 0 THEN ' It keeps ' || (pair_id % 7 * 10 + 20) || ' records apart from xss.' ELSE '' END AS d, {_PICK(_REGISTERS, 5)} AS register, sev, pair_id % 3 = 1 AS cisa, pair_id % 6 = 0 AS doc FROM finding_pairs)"""


def _evidence_sql() -> str:
    rx = {n: "'(?i)" + p.replace("'", "''") + "'" for n, p in evidence.PATTERNS.items()}
    has = lambda t, n: f"regexp_matches({t}, {rx[n]})"
    words = lambda t: rf"len(regexp_extract_all({t}, '\S+'))"
    band = lambda c: "CASE {} {} END".format(c, " ".join(f"WHEN '{k}' THEN {v}" for k, v in evidence.BANDS.items()))
    leaders, named, numbers = "NOT doc AND register = 'technical_leadership'", f"lower(regexp_extract(d, {rx['severity']}, 1))", f"list_transform(regexp_extract_all(s, {rx['number']}, 1), lambda n: replace(n, ',', ''))"
    terms = "list_filter([" + ", ".join(f"'{t}'" for t in evidence.TERMS) + "], lambda t: contains(lower(s), t))"
    first = r"string_split(regexp_replace(d, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1]"
    rows = [
        ("short", "''", "NOT doc", f"{words('d')} / greatest({words('s')}, 1) <= 0.4"), ("mechanism_first", "''", leaders, has(first, "mechanism")), ("business", "''", leaders, has("d", "business")),
        ("calibrated_caveats", "''", f"{leaders} AND {has('s', 'caveat')}", has("d", "calibration")), ("qualified_actors", "''", f"{leaders} AND {has('d', 'actor')}", f"trim(regexp_extract(d, {rx['actor']}, 2)) <> '' OR trim(regexp_extract(d, {rx['actor']}, 4)) <> ''"),
        ("capability", "sev", leaders, has("d", "capability")), ("severity_named", "''", leaders, f"{named} <> ''"), ("severity_softened", "''", f"{leaders} AND {named} <> ''", f"{band(named)} < {band('sev')}"), ("calibration", "''", leaders, has("d", "calibration")),
        ("calibration_at_critical", "''", f"{leaders} AND sev = 'critical'", has("d", "calibration")), ("terms_survive", "''", f"{leaders} AND len({terms}) > 0", f"len(list_filter({terms}, lambda t: contains(lower(d), t))) > 0"),
        ("numbers_survive", "register", f"(register = 'practitioner' OR NOT doc) AND len({numbers}) > 0", f"len(list_filter({numbers}, lambda n: contains(d, n))) > 0"), ("bounded_assurance", "''", "NOT doc AND register = 'customer'", has("d", "assurance")),
        *[(f"document_{n}", "''", "doc", has("d", p)) for n, p in (("verdict", "verdict"), ("counts", "counts"), ("recommendation", "recommendation"), ("severity", "severity_word"))], ("formula", "''", "cisa", has("d", "formula")),
    ]
    parts = " UNION ALL ".join(f"SELECT '{m}' AS measure, {g} AS grp, {h} AS holds FROM written WHERE {a}" for m, g, a, h in rows)
    return f"WITH {FINDING_PAIRS_SQL}, {_WRITTEN}, m AS ({parts}) SELECT measure, grp, count(*) AS n, count(*) FILTER (holds) AS k, round(count(*) FILTER (holds) / count(*), 6) AS share FROM m GROUP BY ALL"


_CHECKS = ", ".join(f"('{c}')" for c in checks.CHECKS)
_UNIT26 = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))"
_LETTERS = "list_transform(['a','b','c','d','e','f','g','h','i','j','k','l','m','n','o','p','q','r','s','t','u','v','w','x','y','z'], lambda c: CAST(length(lower(t)) - length(replace(lower(t), c, '')) AS DOUBLE))"

ORACLE: dict[str, str] = {
    "corpus_evidence": _evidence_sql(),
    "loss_and_recall": f"""SELECT model, error, n, loss, recall, coalesce(recall > 0, false) AS readable FROM (
        SELECT 'm' || (doc_id % 3) AS model, error, count(*) AS n, round(avg(CAST(lost AS INTEGER)), 6) AS loss FROM ({check_queries._ALL_FLAGS} SELECT p.doc_id, c.error, EXISTS (SELECT 1 FROM flags f WHERE f.pair_id = p.pair_id AND f."check" = c.error AND f.level = 'fail') AS lost
          FROM finding_pairs p, (VALUES {_CHECKS}) AS c(error)) GROUP BY ALL)
        LEFT JOIN (SELECT target AS error, round(sum(n_found) / sum(n), 6) AS recall FROM ({check_queries._recall_sql()}) WHERE target <> 'severity_inflation' GROUP BY 1) USING (error)""",
    "genre_outcomes": """SELECT "check", outcome, count(*) AS n, count(DISTINCT id) AS n_drafts FROM (""" + " UNION ALL ".join(f'SELECT id, "check", outcome FROM ({genre_queries.ORACLE[n]})' for n in ("reader_questions", "prohibited_jargon", "format_constants")) + ") GROUP BY ALL",
    "document_tests": r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# Executive Summary' || chr(10) ELSE '' END || coalesce(text, '') || CASE WHEN doc_id % 3 <= 1 THEN chr(10) || '## Results' || chr(10) || 'The risk is low.' ELSE '' END || CASE WHEN doc_id % 50 = 0 THEN repeat(chr(65533), 40) ELSE '' END AS text FROM documents)
        SELECT doc_id, length(text) / (length(text) // 3000 + 1) BETWEEN 400 AND 8000 AS chars_per_page, len(regexp_extract_all(text, chr(65533) || '|Ã.|â€')) / greatest(length(text), 1) < 0.001 AS mojibake, doc_id % 3 = 0 AS summary_heading, doc_id % 3 <= 1 AS findings_heading,
          doc_id % 5 = 0 OR NOT (doc_id % 4 < 2 OR doc_id % 10 / 10.0 > 0.6) AS tables, regexp_matches(text, '(?i)\b(?:critical|high|medium|low|informational)\b') AS severity_word FROM t""",
    "nearest_in_document": f"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), p AS (SELECT doc, n, {_LETTERS} AS v FROM l), u AS (SELECT doc, n, {_UNIT26} AS v FROM p WHERE list_sum(v) > 0),
        c AS (SELECT a.doc, a.n AS sentence, b.n AS target, round(list_dot_product(a.v, b.v), 6) AS cosine FROM u a JOIN u b ON a.doc = b.doc WHERE a.n % 2 = 0 AND b.n % 2 = 1)
        SELECT doc, CAST(sentence AS INTEGER) AS sentence, CAST(target AS INTEGER) AS target, cosine, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc, sentence ORDER BY cosine DESC, target) AS INTEGER) AS rank FROM c) WHERE rank <= 5""",
    "adapted_harvest": r"""WITH d AS (SELECT doc_id AS k, text, lang, source FROM documents), b AS (SELECT *, CASE k % 3 WHEN 0 THEN 'csrb' WHEN 1 THEN 'gao' ELSE 'oig' END AS kind, CASE WHEN k % 8 = 0 THEN 'Report of ' || (2000 + k % 25) || ' on ' || source ELSE 'Report on ' || source END AS title FROM d WHERE k % 4 = 0)
        SELECT 'board' AS what, 'b' || k AS id, kind || '/' || CASE WHEN k % 8 = 0 THEN CAST(2000 + k % 25 AS VARCHAR) ELSE '2019' END || '-' || regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS source_doc_id, CASE WHEN k % 3 = 0 THEN lang ELSE upper(kind) END AS source_org,
          CASE k % 3 WHEN 0 THEN 'csrb_report' WHEN 1 THEN 'gao_report' ELSE 'oig_audit' END || '|' || title || '|board|public-domain-us-gov|' AS facts, md5(text || '|' || CASE WHEN k % 16 = 0 THEN 'board says' ELSE 'all say' END) AS texts_md5 FROM b
        UNION ALL SELECT 'advisory', 'GHSA-' || k, 'ghsa/' || CASE WHEN k % 8 = 1 THEN CAST(2015 + k % 9 AS VARCHAR) ELSE '0000' END || '-ghsa-' || k, 'GHSA', 'ghsa_advisory|' || source || ' (' || CASE k % 2 WHEN 0 THEN 'LOW' ELSE 'HIGH' END || ')|developer|' || CASE k % 2 WHEN 0 THEN 'Low' ELSE 'High' END || '|cc-by-4.0|vuln_class_harvest=' || lang, md5(text || '|' || left(text, 50)) FROM d WHERE k % 4 = 1
        UNION ALL SELECT 'register', CASE WHEN k % 3 = 0 THEN 'story' ELSE 'public' END, lang, source, 'research-quotation-noncommercial|' || (k % 5), md5(text) FROM d WHERE k % 4 = 2 AND k % 7 <> 0
        UNION ALL SELECT 'register', 'investor', lang, source, 'edgar-public-filing', md5(text) FROM d WHERE k % 8 = 3
        UNION ALL SELECT 'register', 'customer', lang, source, 'public-record-breach-notification', md5(text) FROM d WHERE k % 8 = 7 AND NOT (k % 16 = 7 AND k % 3 = 0)""",
}
