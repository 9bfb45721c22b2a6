"""From candidate pairs to the dataset: union, identity, verdicts, the inclusion gate with a reason for every drop, enrichment, group pairs, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import blank_to_null, clip_at_word, first_match, has_email, let, matches, none_of, sorted_set, strip

# Tables and thresholds that the dataset's contents depend on.
LICENCE_NAMES = {
    "public-domain": "public-domain-us-gov", "cc by-sa 4.0": "cc-by-sa-4.0", "cc by-sa 3.0": "cc-by-sa-3.0", "cc by-sa 2.5": "cc-by-sa-2.5",
    "cc by 3.0 us": "cc-by-3.0-us", "cc-by-4.0": "cc-by-4.0", "cc by 4.0": "cc-by-4.0", "ogl-v3-uk": "ogl-uk-3.0",
}
ORG_LICENCE = {"trailofbits": "cc-by-sa-4.0", "cisa": "public-domain-us-gov"}
OTHER_LICENCE = "research-quotation-noncommercial"
ORG_TYPE = {"trailofbits": "consultancy", "cisa": "government", "cure53": "consultancy", "ostif": "nonprofit"}
DOC_ORG_TYPE = {
    "oig_audit": "government", "oig_inspection": "government", "gao_report": "government", "csrb_report": "government", "ghsa_advisory": "maintainer",
    "ftc_complaint": "government", "sec_complaint": "government", "sec_admin_order": "government", "incident_postmortem": "vendor",
    "sec_8k_item105": "issuer", "wikipedia_article": "encyclopedia",
}
TOPICS = (
    ("web", r"xss|csrf|ssrf|sql injection|idor|cookie|session|http|url|endpoint|api"),
    ("crypto", r"cryptograph|signature|key material|encryption|nonce|hash|zero-knowledge|zk|mpc|dkg"),
    ("cloud", r"kubernetes|container|docker|aws|gcp|azure|iam|s3|ci/cd|pipeline|workflow"),
    ("network", r"tls|certificate|dns|packet|firewall|port|protocol"),
    ("ics", r"plc|scada|modbus|industrial"),
    ("access_control", r"privilege|permission|authoriz|access control|authentication"),
    ("memory", r"overflow|use-after-free|memory safety|out-of-bounds|null pointer"),
)
GROUP_SEVERITIES = ("", "informational", "undetermined", "low", "medium", "high", "critical")
BAD_VERDICTS = ("unaligned", "api_error", "parse_error")
HELD_OUT_FIRMS, HELD_OUT_YEAR, SPLIT_SEED = ("Doyensec", "NCCGroup"), 2026, "20260707:"
FACTS = r"\b\d+(?:\.\d+)+\b|\b\d{2,}\b|\b\d+(?:\.\d+)?%"


def looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


# --- columns ---


def topic(text: Column) -> Column:
    """The first topic of which a word stands in the first 3000 characters, else ``other``."""
    head, out = F.left(text, F.lit(3000)), F.lit("other")
    for name, pattern in reversed(TOPICS):
        out = F.when(head.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def year_of(doc_id: Column) -> Column:
    """A year after a slash and before a hyphen, else the first 20xx, else null."""
    found = F.coalesce(first_match(doc_id, r"/(\d{4})-", 1), first_match(doc_id, r"(20\d\d)", 1))
    return found.try_cast("int")


def licence(own: Column, org: Column) -> Column:
    """The record's own, else its organisation's, else the default; under one name for each."""
    name = F.coalesce(F.nullif(own, F.lit("")), looked_up(org, ORG_LICENCE), F.lit(OTHER_LICENCE))
    return F.coalesce(looked_up(F.lower(name), LICENCE_NAMES), name)


def org_type(doc_type: Column, org: Column) -> Column:
    return F.coalesce(looked_up(doc_type, DOC_ORG_TYPE), looked_up(org, ORG_TYPE), F.lit("consultancy"))


def clean_year(value: Column) -> Column:
    """A whole number from 1990 to 2100, else null."""
    year = value.cast("string").try_cast("int")
    return F.when(year.between(1990, 2100), year)


def clean_severity(value: Column) -> Column:
    """In lower case, with ``info`` as ``informational``; blank is null."""
    low = F.lower(blank_to_null(value))
    return F.when(low == "info", F.lit("informational")).otherwise(low)


def split_share(doc: Column, seed: str = SPLIT_SEED) -> Column:
    """A number in [0, 1) from the document's name: the first 12 hex digits of a SHA-1."""
    return F.conv(F.substr(F.sha1(F.concat(F.lit(seed), doc)), F.lit(1), F.lit(12)), 16, 10).cast("double") / F.lit(float(16**12))


def split_of(doc: Column, org: Column | None = None, year: Column | None = None, forced: Column | None = None) -> Column:
    """train below .8, val below .9, else test; held-out firms and years first, a forced split before all."""
    x = split_share(doc)
    out = F.when(x < 0.8, "train").when(x < 0.9, "val").otherwise("test")
    if year is not None:
        out = F.when(year >= HELD_OUT_YEAR, "test_ood_temporal").otherwise(out)
    if org is not None:
        out = F.when(org.isin(*HELD_OUT_FIRMS), "test_ood_firm").otherwise(out)
    return F.coalesce(forced, out) if forced is not None else out


def enrich(rows: DataFrame) -> DataFrame:
    """Candidates in the one shape of the dataset, derived columns filled. Missing columns count as empty."""
    has = lambda name, kind="string": F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    text = lambda name: F.coalesce(has(name), F.lit(""))
    tech, execu = text("technical_text"), text("executive_text")
    both = F.concat(tech, F.lit(" "), execu)
    return rows.select(
        "pair_id", "source_doc_id", "source_org", org_type(has("doc_type"), F.col("source_org")).alias("source_org_type"), text("source_url").alias("source_url"), has("doc_type").alias("doc_type"),
        year_of(F.col("source_doc_id")).alias("report_year"), tech.alias("technical_text"), text("technical_context").alias("technical_context"), execu.alias("executive_text"),
        F.lit("natural").alias("executive_text_provenance"), text("audience_observed").alias("audience_observed"), F.lit(None).cast("string").alias("audience_label"),
        F.when(has("exec_span_kind") == "bullet_list", "bullet").otherwise("paragraph").alias("format_label"), text("severity_original").alias("severity_original"),
        F.lit(None).cast("string").alias("severity_conveyed"), sorted_set(matches(both, r"CVE-\d{4}-\d{4,7}")).alias("cve_ids"), sorted_set(matches(both, r"CWE-\d{1,4}")).alias("cwe_ids"),
        topic(tech).alias("vuln_class"), F.slice(sorted_set(matches(tech, FACTS)), 1, 40).alias("numeric_facts"), text("alignment_method").alias("alignment_method"), text("alignment_type").alias("alignment_type"),
        F.coalesce(has("alignment_label"), F.lit("structural")).alias("alignment_label"), has("alignment_confidence", "double").alias("alignment_confidence"), F.lit(False).alias("human_verified"),
        (~has_email(both)).alias("pii_scrubbed"), licence(has("license"), F.col("source_org")).alias("license"), has("split").alias("split"), F.coalesce(has("exec_span_kind"), F.lit("prose")).alias("exec_span_kind"), text("notes").alias("notes"),
    )


# --- rows ---


def union_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """All candidates under one schema, with ``tag`` and ``tag_order``; keys that a source lacks are null."""
    out = None
    for order, (tag, rows) in enumerate(sources):
        rows = rows.withColumns({"tag": F.lit(tag), "tag_order": F.lit(order)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in order, which must be total for the result to be stable."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def last_verdicts(verdicts: DataFrame, order: str = "file_order") -> DataFrame:
    """One verdict per pair: that of the last file."""
    return first_by(verdicts, ["pair_id"], [F.desc(order)])


def gate(candidates: DataFrame, verdicts: DataFrame, near_duplicates: DataFrame, order: list[str], doclevel_kinds: tuple[str, ...] = ("doc_level",), strict_tags: tuple[str, ...] = ("gov_audit", "llm_rescue")) -> DataFrame:
    """``candidates`` with ``alignment_label``, ``alignment_confidence`` and ``drop_reason``, null for those kept.

    One ordered decision list, so each row has one reason: a pair id seen before, a known near-duplicate, a
    document-level pair whose section check failed, no verdict where one is needed, a bad verdict, and a
    thematic pair below .80. Kept and dropped rows add up to what came in.
    """
    seen = F.row_number().over(W.partitionBy("pair_id").orderBy(*order)) > 1
    v = verdicts.select("pair_id", F.col("alignment_label").alias("_label"), F.col("alignment_confidence").alias("_conf"))
    near = near_duplicates.select("pair_id").distinct().withColumn("_near", F.lit(True))
    rows = candidates.withColumn("_seen", seen).join(v, "pair_id", "left").join(near, "pair_id", "left")
    doclevel, needs = F.coalesce(F.col("exec_span_kind").isin(*doclevel_kinds), F.lit(False)), F.coalesce(F.col("needs_llm_verify"), F.lit(False))
    bad, thematic = F.coalesce(F.col("_label").isin(*BAD_VERDICTS), F.lit(False)), F.col("tag") == "tob_thematic"
    conf = F.coalesce(first_match(F.col("notes"), r"adj_conf=([\d.]+)", 1).try_cast("double"), F.lit(0.0))
    reason = (
        F.when(F.col("_seen"), "duplicate_id").when(F.col("_near"), "near_duplicate")
        .when(doclevel & F.col("tag").isin(*strict_tags) & needs & bad, "doclevel_positional_rejected")
        .when(~doclevel & needs & F.col("_label").isNull() & ~thematic, "unverified_pending")
        .when(~doclevel & bad, F.concat(F.lit("verifier_"), F.col("_label")))
        .when(thematic & (conf < 0.8), "thematic_low_conf")
    )
    label = F.when(thematic, "aligned").when(doclevel, "structural_doclevel").otherwise(F.coalesce("_label", F.lit("structural")))
    confidence = F.when(thematic, conf).when(~doclevel, F.col("_conf"))
    return rows.withColumns({"alignment_label": label, "alignment_confidence": confidence, "drop_reason": reason}).drop("_seen", "_label", "_conf", "_near")


def publication_gate(rows: DataFrame, licences: tuple[str, ...], licence_column: str = "license", scrubbed: str = "pii_scrubbed") -> DataFrame:
    """``rows`` with ``drop_reason``: licence unknown, licence not in the set, or not known to be scrubbed."""
    known = F.nullif(F.trim(F.col(licence_column)), F.lit(""))
    return rows.withColumn("drop_reason", F.when(known.isNull(), "licence_unknown").when(~known.isin(*licences), "licence_closed").when(~F.col(scrubbed).eqNullSafe(True), "pii"))


def group_pairs(rows: DataFrame, key: list[str], order: list[str], member_chars: int = 2500, most_chars: int = 14000) -> DataFrame:
    """One row per key with two members or more: their texts joined under a header each, facts united, and the strongest severity; the first member gives the rest."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, GROUP_SEVERITIES)), clean_severity(F.col("severity_original"))), F.lit(1))
    header = F.concat(F.lit("["), F.col("technical_context"), F.lit("] (severity: "), F.coalesce(F.nullif("severity_original", F.lit("")), F.lit("n/a")), F.lit(")\n"), F.left("technical_text", F.lit(member_chars)))
    keyed = F.struct(*order)
    grouped = rows.withColumns({"_rank": rank, "_text": header}).groupBy(*key).agg(
        F.count("*").alias("n_members"), F.min_by("pair_id", keyed).alias("first_id"), F.array_sort(F.collect_list(F.struct(*order, "_text"))).alias("_t"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("numeric_facts")))), 1, 40).alias("numeric_facts"), F.max_by("severity_original", F.struct("_rank", "severity_original")).alias("severity_original"),
    )
    text = F.left(F.array_join(F.transform("_t", lambda x: x["_text"]), "\n\n---\n\n"), F.lit(most_chars))
    return grouped.where("n_members > 1").withColumn("technical_text", text).drop("_t")


def covered_by_group(rows: DataFrame, groups: DataFrame, doc: str, text: str) -> DataFrame:
    """``rows`` less those of which a group row of the same document has the same text, blanks around it aside; an empty text is never covered."""
    keys = groups.select(F.col(doc).alias("_d"), strip(F.col(text)).alias("_t")).where("_t <> ''").distinct()
    return rows.join(keys, (F.col(doc) == F.col("_d")) & (strip(F.col(text)) == F.col("_t")), "left_anti")


def append_new(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` whose key is not in ``known``, one of each."""
    return new.join(known.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def tier_of(label: Column, curated: Column, method: Column) -> Column:
    """T1 curated, T2 aligned by identifier, T3 other aligned or structural, none."""
    return F.when(curated, "T1").when((label == "aligned") & (method == "id_anchor"), "T2").when(label.isin("aligned", "structural", "structural_doclevel"), "T3")


def first_paragraphs(text: Column, cap: int = 180) -> Column:
    """The first paragraphs within ``cap`` words in all; the first one whatever its length."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")
    count = lambda p: F.size(F.regexp_extract_all(p, F.lit(r"\S+"), F.lit(0)))
    start = F.struct(none_of().alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def add(s: Column, p: Column) -> Column:
        fits = s["open"] & ((F.size(s["kept"]) == 0) | (s["n"] + count(p) <= cap))
        return F.struct(F.when(fits, F.concat(s["kept"], F.array(p))).otherwise(s["kept"]).alias("kept"), F.when(fits, s["n"] + count(p)).otherwise(s["n"]).alias("n"), fits.alias("open"))

    return let(F.aggregate(parts, start, add), lambda s: F.array_join(s["kept"], "\n\n"))


def url_by_alias(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """``records(doc, url)`` with blank urls filled from ``manifest(key, url, manifest_order)``: by the exact name, else by its first alias that is known; the first manifest wins; what is there stays.

    Aliases: without extension, and each part between double underscores of six characters or more.
    """
    plain = F.regexp_replace(F.lower("doc"), r"\.(?:pdf|md|html?|json)$", "")
    parts = F.filter(F.split(plain, "__"), lambda p: F.length(p) >= 6)
    keys = records.select("doc", F.posexplode(F.array_distinct(F.concat(F.array("doc"), F.array(plain), parts))).alias("tier", "key"))
    found = keys.join(manifest.where("url <> ''"), "key").groupBy("doc").agg(F.min_by("url", F.struct("tier", "manifest_order", "url")).alias("_url"), F.min("tier").alias("tier"))
    return records.join(found, "doc", "left").withColumn("url", F.coalesce(blank_to_null(F.col("url")), F.col("_url"), F.lit(""))).drop("_url")


def display_clip(text: Column, limit: int) -> Column:
    return clip_at_word(text, limit)["text"]
