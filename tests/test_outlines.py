"""audits are cut by the places of their headings, in one reading of the documents."""

import random
import re

from pairwright.operators import composite

HEADS = ["# Executive Summary", "## Results in Brief 3", "# Findings", "## Findings again", "# Background", "# II. Background", "# Late reviews", "# Appendix A", "#", "####### seven", " # Findings", "# Findings\r"]
BODIES = ["", "text", "a\r", "ö wide", "<!-- c -->", "word " * 60, "patches " * 200]


def documents():
    r = random.Random(3)
    some = ["\n".join(r.choice(HEADS) if r.random() < 0.5 else r.choice(BODIES) for _ in range(r.randrange(1, 16))) for _ in range(400)]
    return [*some, "", "\n", "\n# Findings\n", None]


def span(text, begin, end, stop_least, least, most):
    """By the lines of the text, one after another."""
    lines = (text or "").split("\n")
    titles = {n: m[1].strip() for n, t in enumerate(lines) if (m := re.search(composite.HEADING, t))}
    upto = [sum(len(t) + 1 for t in lines[:n]) for n in range(len(lines) + 1)]
    found = []
    for a in [n for n, t in titles.items() if re.search(begin, t)]:
        stops = [n for n, t in titles.items() if n > a and re.search(end, t)]
        z = next((n for n in stops if upto[n] - upto[a] - 1 >= stop_least), stops[0] if stops else len(lines))
        found.append((not least <= upto[z] - upto[a] - 1 <= most, a, z))
    return min(found)[1:] if found else None


def test_spans_equal_those_by_lines(spark):
    texts = documents()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")
    for args in ((composite.AUDIT_SUMMARY, composite.SUMMARY_STOP, 300, 200, 900), ("(?i)^f", "(?i)^(?:b|a|l)", 5, 1, 60)):
        got = {r.doc: (r.start, r.stop) for r in composite.first_plausible(docs, *args).collect()}
        want = {n: s for n, t in enumerate(texts) if (s := span(t, *args))}
        assert got == want and len(got) > 100


def test_f24_an_audit_is_read_once_and_not_shuffled(spark):
    docs = spark.createDataFrame([("a", "# Findings\nfirst " + "x" * 400 + "\n# Executive Summary\n" + "we " * 99 + "\n# Findings\nlast " + "y" * 500 + "\n# Appendix\nz"), ("b", None)], "doc string, text string")
    out = composite.audit_pairs(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and not any(x in plan for x in ("Join", "Aggregate", "Generate", "Window"))
    a, b = out.orderBy("doc").collect()
    assert a.executive_text.startswith("we we") and a.technical_text == "last " + "y" * 500 and a.reason is None and b.reason == "no summary section"
