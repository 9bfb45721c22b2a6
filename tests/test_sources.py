import json

from pairwright.functions import text as T
from pairwright.operators import assemble, graph, retrieve, sequences
from pairwright.sources import records
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def test_json_lines(spark, tmp_path):
    lines = [json.dumps({"pair_id": "1", "technical_text": "form\u000cfeed and   stay"}), "", "{broken", json.dumps({"pair_id": "2", "extra": 1})]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    good, bad = records.read_json_lines(spark, str(tmp_path / "c.jsonl"), records.CANDIDATE)
    assert {r["pair_id"]: r["technical_text"] for r in good.collect()} == {"1": "form\u000cfeed and   stay", "2": None}
    assert [r["value"] for r in bad.collect()] == ["{broken"]


def test_manifests(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "url": "u1"}]))
    (tmp_path / "b.json").write_text(json.dumps({"k": {"id": "y", "url": "u2"}}))
    (tmp_path / "c.json").write_text("nonsense")
    got = {r["id"]: r["url"] for n in "abc" for r in records.read_manifest(spark, str(tmp_path / f"{n}.json")).collect()}
    assert got == {"x": "u1", "y": "u2"}


def test_documents_and_append(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a__b__c.md").write_text("line\nline")
    assert [(r["doc"], r["parts"], r["text"]) for r in records.read_documents(spark, str(tmp_path / "d")).collect()] == [("a__b__c", ["a", "b", "c"], "line\nline")]
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, t string")
    for _ in range(2):
        records.append_once(rows, str(tmp_path / "out"), "id")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_script_safe_json(spark):
    out = spark.range(1).select(records.script_safe_json(F.struct(F.lit("<a>&</a>").alias("x")))).first()[0]
    assert "<" not in out and ">" not in out and "&" not in out and json.loads(out) == {"x": "<a>&</a>"}


def test_components(spark):
    links = [(k, k + 1) for k in range(200)] + [(300, 310), (310, 305), (9, 9), (400, 401)]
    rows = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["id"]: r["root"] for r in graph.components(rows).collect()}
    assert got == {**{k: 0 for k in range(201)}, 300: 300, 305: 300, 310: 300, 400: 400, 401: 400}
    assert graph.components(rows.limit(0)).count() == 0


def test_gate_accounts_for_every_row(spark):
    schema = StructType([StructField(n, StringType()) for n in ("pair_id", "tag", "exec_span_kind", "notes")])
    rows = spark.createDataFrame([("1", "a", "prose", ""), ("1", "b", "prose", ""), ("2", "a", "prose", ""), ("3", "tob_thematic", "prose", "adj_conf=0.79"), ("4", "tob_thematic", "prose", "adj_conf=0.9"), ("5", "gov_audit", "doc_level", ""), ("6", "a", "prose", "")], schema).withColumn("needs_llm_verify", F.col("pair_id").isin("2", "5"))
    verdicts = spark.createDataFrame([("5", "unaligned", 0.1), ("6", "parse_error", None)], "pair_id string, alignment_label string, alignment_confidence double")
    out = assemble.gate(rows, verdicts, rows.limit(0).select("pair_id"), ["tag"])
    got = {(r["pair_id"], r["tag"]): r["drop_reason"] for r in out.collect()}
    assert got == {("1", "a"): None, ("1", "b"): "duplicate_id", ("2", "a"): "unverified_pending", ("3", "tob_thematic"): "thematic_low_conf", ("4", "tob_thematic"): None, ("5", "gov_audit"): "doclevel_positional_rejected", ("6", "a"): "verifier_parse_error"}


def test_urls_by_alias(spark):
    docs = spark.createDataFrame([("org__longname__x.pdf", ""), ("kept", "http://own"), ("none", "")], "doc string, url string")
    manifest = spark.createDataFrame([("longname", "http://late", 2), ("longname", "http://early", 1), ("kept", "http://other", 1), ("org", "http://short", 1)], "key string, url string, manifest_order int")
    assert {r["doc"]: r["url"] for r in assemble.url_by_alias(docs, manifest).collect()} == {"org__longname__x.pdf": "http://early", "kept": "http://own", "none": ""}


def test_sections(spark):
    rows = spark.createDataFrame([("d", k, t) for k, t in enumerate(["pre", "# A", "a1", "## B", "b1", "# C", "c1"])], "doc string, n int, t string")
    level = F.length(F.regexp_extract("t", "^(#+)", 1))
    got = [(r["n"], r["heading"]) for r in sequences.with_sections(rows, "doc", "n", level > 0, F.col("t")).orderBy("n").collect()]
    assert got == [(0, None), (1, "# A"), (2, "# A"), (3, "## B"), (4, "## B"), (5, "# C"), (6, "# C")]
    ends = {r["t"]: r["end"] for r in sequences.section_end(rows.where(level > 0), "doc", "n", level).collect()}
    assert ends == {"# A": 5, "## B": 5, "# C": None}
    ranges = spark.range(1).select(sequences.paragraph_ranges(F.lit("see paragraphs 13 to 29, 31 and 40-42."))).first()[0]
    assert [(r["a"], r["b"]) for r in ranges] == [(13, 29), (31, 31), (40, 42)]
    table = spark.range(1).select(sequences.numbered_table(F.lit("| # | T | S |\n|---|---|---|\n| 1 | Bad auth | x | High |\n| 2 | Leak | Low |"))).first()[0]
    assert [tuple(r) for r in table] == [(1, "Bad auth", "High"), (2, "Leak", "Low")]


def test_search_abstains(spark):
    docs = spark.createDataFrame([(1, "a buffer overflow in the parser CVE-2024-1111"), (2, "weak cookie flags on login"), (3, "nothing here at all")], "id bigint, t string")
    asked = spark.createDataFrame([(10, "CVE-2024-1111 and unrelated wording"), (11, "cookie flags are weak on the login page"), (12, "zebra quantum")], "id bigint, t string")
    got = [(r["query"], r["doc"], r["exact"]) for r in retrieve.search(asked, docs, "id", "t", "id", "t").where("rank = 1").orderBy("query").collect()]
    assert got == [(10, 1, True), (11, 2, False)]


def test_spans_and_quotes(spark):
    f = lambda *c: spark.range(1).select(*c).first()
    text = F.lit("The  quick\nbrown fox jumps over the lazy dog")
    assert f(T.verbatim_slice(text, F.lit("quick brown fox")))[0] == "quick\nbrown fox"
    assert f(T.quote_match(text, F.lit("The quick ... lazy dog")), T.quote_match(text, F.lit("lazy dog ... quick")), T.quote_match(text, F.lit("no such ... dog")), T.quote_match(text, F.lit("brown fox")))[:] == ("ordered", "unordered", "none", "verbatim")
    assert f(T.clip_at_word(F.lit("abcdef ghi"), 8))[0]["text"] == "abcdef" and not f(T.clip_at_word(F.lit("ab"), 8))[0]["cut"]
    assert f(T.run_lengths(F.array(*map(F.lit, (1, 2, 3, 7, 9, 10)))))[0] == ["P1-P3", "P7", "P9-P10"]
    assert f(assemble.first_paragraphs(F.lit("a b c\n\nd e\n\nf"), 5))[0] == "a b c\n\nd e"
