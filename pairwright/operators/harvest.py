"""Adapters: harvested rows of differing shape as candidate pairs of one schema, and register material that judges kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from ..sources.records import CANDIDATE

# Kinds of documents by the body that published them, and licences.
BOARD_KINDS = {"CSRB": "csrb_report", "GAO": "gao_report"}
BOARD_LICENCE, ADVISORY_LICENCE, REGISTER_LICENCE = "public-domain-us-gov", "cc-by-4.0", "research-quotation-noncommercial"
YEAR = r"(20\d\d)"


def adapted(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``rows`` under the schema of candidates: the fields given, all others null. A name that the schema lacks is an error."""
    unknown = set(fields) - set(CANDIDATE.names)
    if unknown:
        raise ValueError(f"not fields of a candidate: {sorted(unknown)}")
    return rows.select(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANDIDATE])


def _text(*names: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def board_candidates(rows: DataFrame) -> DataFrame:
    """Of ``rows(pair_id, source, report_title, agency, source_url, technical_text, board_text, executive_text, note)``; the year is that of the title, else of the address, else 0000."""
    source, title = F.upper(_text("source")), _text("report_title")
    year = F.coalesce(F.nullif(F.regexp_extract(title, YEAR, 1), F.lit("")), F.nullif(F.regexp_extract(_text("source_url"), YEAR, 1), F.lit("")), F.lit("0000"))
    kind = F.coalesce(*[F.when(source == k, F.lit(v)) for k, v in BOARD_KINDS.items()], F.lit("oig_audit"))
    return adapted(rows, {
        "pair_id": F.col("pair_id"), "source_doc_id": F.concat(F.lower(source), F.lit("/"), year, F.lit("-"), slug(title)), "source_org": F.coalesce(F.nullif(F.col("agency"), F.lit("")), source), "doc_type": kind,
        "technical_text": _text("technical_text"), "technical_context": title, "executive_text": _text("board_text", "executive_text"), "audience_observed": F.lit("board"), "exec_span_kind": F.lit("prose"),
        "alignment_method": F.lit("board_extract"), "alignment_type": F.lit("1:1"), "license": F.lit(BOARD_LICENCE), "source_url": _text("source_url"), "needs_llm_verify": F.lit(True), "notes": _text("note"),
    })


def advisory_candidates(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """Of ``rows(ghsa_id, package, severity, technical_text, impact_text, source_url, vuln_class)``; ``dates(ghsa_id, published)`` gives the year, 0000 where it is not known."""
    known = rows.join(dates.select("ghsa_id", "published"), "ghsa_id", "left")
    year = F.left(F.coalesce(F.nullif(F.col("published"), F.lit("")), F.lit("0000")), F.lit(4))
    severity = _text("severity")
    return adapted(known, {
        "pair_id": F.col("ghsa_id"), "source_doc_id": F.concat(F.lit("ghsa/"), year, F.lit("-"), F.lower("ghsa_id")), "source_org": F.lit("GHSA"), "doc_type": F.lit("ghsa_advisory"), "technical_text": F.col("technical_text"),
        "technical_context": F.concat(_text("package"), F.lit(" ("), severity, F.lit(")")), "executive_text": F.col("impact_text"), "audience_observed": F.lit("developer"), "exec_span_kind": F.lit("prose"), "alignment_method": F.lit("ghsa_impact"),
        "alignment_type": F.lit("1:1"), "severity_original": F.concat(F.upper(F.left(severity, F.lit(1))), F.lower(F.substring(severity, 2, 1000))), "license": F.lit(ADVISORY_LICENCE), "source_url": _text("source_url"), "needs_llm_verify": F.lit(True),
        "notes": F.concat(F.lit("vuln_class_harvest="), _text("vuln_class")),
    })


def register_material(judged: DataFrame, filings: DataFrame, letters: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(``text``, ``kind``, ``concept``, ``source``, ``license``, ``score``): examples of registers.

    Of ``judged(text, mode, concept, source, license, score, verdict)`` what was kept; all ``filings(text, concept, source)``, for investors; of
    ``letters(id, text, concept, source)`` to customers all that ``verdicts(id, verdict)`` does not drop, also those without a verdict.
    """
    columns = lambda kind, licence, score: [_text("text").alias("text"), kind.alias("kind"), _text("concept").alias("concept"), _text("source").alias("source"), licence.alias("license"), score.cast("double").alias("score")]
    kept = judged.where(F.col("verdict") == "keep").select(*columns(F.coalesce(F.nullif(F.col("mode"), F.lit("")), F.lit("public")), F.coalesce(F.nullif(F.col("license"), F.lit("")), F.lit(REGISTER_LICENCE)), F.col("score")))
    investor = filings.select(*columns(F.lit("investor"), F.lit("edgar-public-filing"), F.lit(None)))
    told = letters.join(verdicts.select("id", "verdict"), "id", "left").where(~F.col("verdict").eqNullSafe("drop"))
    return kept.unionByName(investor).unionByName(told.select(*columns(F.lit("customer"), F.lit("public-record-breach-notification"), F.lit(None))))
