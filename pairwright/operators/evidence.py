"""Measures of how drafts are written: each is the share of pairs that it applies to for which it holds, all in one pass over the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches, sentences

# The wordings that the measures look for, all without regard to case.
PATTERNS = {
    "severity": r"\b(critical|high|medium|moderate|low|informational)([- ]severity|[- ]risk|[- ]impact)?\b",
    "capability": r"\b(can|could|may|would|allow\w*|enabl\w*|lets?|possible|risk of|leads? to|leading to|result\w* in|expos\w*|cause\w*)\b",
    "business": r"\b(revenue|financial|cost|budget|fine[sd]?|penalt|lawsuit|legal|regulat|complian|reputation|customer trust|business|monetar|insurance|liabilit|shareholder|investor)\b",
    "calibration": r"\b(not (directly )?exploit|difficult[- ]to[- ]exploit|hard to exploit|no evidence|did not (uncover|find|identify|observe)|unlikely|low likelihood|edge case|defense[- ]in[- ]depth|theoretical|requires? (an? )?(attacker|authenticat|local|physical|admin|elevated|privileged)|would require|cannot be (directly )?exploit|mitigated|prevented (by|via)|not currently exploitable|no direct|limited impact|only if|only when)\b",
    "caveat": r"\b(requires? (an? )?(authenticat|local|physical|admin|elevated|user interaction)|only if|only when|difficult to exploit|no evidence|not exploitable|theoretical|low likelihood)\b",
    "actor": r"\b(an?y?|any|the)\s+((?:malicious|unauthenticated|authenticated|unprivileged|low-privileged|local|remote|network|physical(?:ly)?)\s+)?(attacker|adversary|user|member|site|website|actor|insider|employee|prover|client)s?\b((?:\s+(?:with|on|in|who|present on|able to)\s+[\w\s'-]{3,40})?)",
    "mechanism": r"^(the|a|an)\s+\w+[\w .\-]*?\s(system|application|app|service|platform|codebase|library|protocol|contract|implementation|component|website|site|product|API|network|firmware|device|server)\b",
    "number": r"(\d[\d,\.]*)\s*(%|percent|records?|users?|customers?|accounts?|victims?|consumers?|months?|days?|years?|hours?|vulnerabilit|systems?|servers?|locations?|repositories|downloads?|instances?|devices?)",
    "assurance": r"\b(no evidence|we believe|we are confident|out of an abundance of caution|we have no indication|at this time)\b",
    "verdict": r"\b(mature|robust|well[- ](tested|structured|documented|designed|written)|sound|solid|high[- ]quality|good (security )?posture|security posture|defense[- ]in[- ]depth|immature|adequate|insufficient testing|lacks? (documentation|tests)|code quality)\b",
    "counts": r"\b(\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+(findings?|issues?|vulnerabilit|flaws?|recommendations?)\b",
    "recommendation": r"\b(we recommend|should|must|advise|prioritize|remediat)\b",
    "severity_word": r"\b(critical|high|medium|low|informational)[- ]severity\b",
    "formula": r"successful exploitation of (this|these) vulnerabilit(y|ies) could",
}
BANDS = {"critical": 4, "high": 3, "medium": 2, "moderate": 2, "low": 1, "informational": 0, "info": 0}
TERMS = (
    "cross-site scripting", "xss", "sql injection", "csrf", "ssrf", "remote code execution", "buffer overflow", "race condition", "reentrancy", "denial of service", "privilege escalation", "deserialization",
    "path traversal", "out-of-bounds", "integer overflow", "use-after-free", "man-in-the-middle", "nonce",
)
BAND_NAMES = ("critical", "high", "medium", "low", "informational")
SHORT = 0.4


def _has(text: Column, name: str) -> Column:
    return text.rlike("(?i)" + PATTERNS[name])


def _band(word: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in BANDS.items() for x in (k, v)]), word)


def measures(source: Column, draft: Column, register: Column, severity: Column, org: Column, doc_level: Column) -> Column:
    """An array of ``struct<measure, grp, applies, holds>`` of one pair; what does not apply is not looked for, and does not hold.

    ``grp`` is the band or register where a measure is told apart by it, else empty. Of the register ``technical_leadership``: first sentences that
    begin with a mechanism, business words, calibration where the source has a caveat, actors that are qualified, capability by band,
    severity words, severities that are softened by word, calibration over all and at critical, and terms that survive. By register: numbers that
    survive. Of ``customer``: bounded assurance. Of whole documents: verdicts, counts, recommendations, severity words. Of pairs, not whole documents:
    drafts of at most 40 % of the source's words. Of ``cisa``: its formula.
    """
    leaders = ~doc_level & (register == "technical_leadership")
    finding = ~doc_level
    own = F.lower(severity)
    actor = lambda k: F.trim(F.regexp_extract(draft, "(?i)" + PATTERNS["actor"], k))
    named = F.lower(F.regexp_extract(draft, "(?i)" + PATTERNS["severity"], 1))
    words = lambda t: F.size(matches(t, r"\S+"))
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(source, F.lit("(?i)" + PATTERNS["number"]), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit(""))))
    terms = F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.contains(F.lower(source), t))
    none = F.lit("")
    rows = [
        ("short", none, finding, words(draft) / F.greatest(words(source), F.lit(1)) <= SHORT),
        ("mechanism_first", none, leaders, _has(F.coalesce(F.get(sentences(draft), F.lit(0)), none), "mechanism")),
        ("business", none, leaders, _has(draft, "business")),
        ("calibrated_caveats", none, leaders & _has(source, "caveat"), _has(draft, "calibration")),
        ("qualified_actors", none, leaders & (actor(0) != ""), (actor(2) != "") | (actor(4) != "")),
        ("capability", own, leaders & own.isin(*BAND_NAMES), _has(draft, "capability")),
        ("severity_named", none, leaders & own.isin(*BANDS), named != ""),
        ("severity_softened", none, leaders & own.isin(*BANDS) & (named != ""), _band(named) < _band(own)),
        ("calibration", none, leaders, _has(draft, "calibration")),
        ("calibration_at_critical", none, leaders & (own == "critical"), _has(draft, "calibration")),
        ("terms_survive", none, leaders & (F.size(terms) > 0), F.exists(terms, lambda t: F.contains(F.lower(draft), t))),
        ("numbers_survive", register, ((register == "practitioner") | finding) & (F.size(numbers) > 0), F.exists(numbers, lambda n: F.contains(draft, n))),
        ("bounded_assurance", none, finding & (register == "customer"), _has(draft, "assurance")),
        *[(f"document_{n}", none, doc_level, _has(draft, p)) for n, p in (("verdict", "verdict"), ("counts", "counts"), ("recommendation", "recommendation"), ("severity", "severity_word"))],
        ("formula", none, org == "cisa", _has(draft, "formula")),
    ]
    return F.array(*[F.struct(F.lit(m).alias("measure"), F.coalesce(g, none).alias("grp"), applies.alias("applies"), F.when(applies, F.coalesce(h, F.lit(False))).otherwise(F.lit(False)).alias("holds")) for m, g, applies, h in ((m, g, F.coalesce(a, F.lit(False)), h) for m, g, a, h in rows)])


def evidence(pairs: DataFrame, source: str = "source_text", draft: str = "draft_text", register: str = "register", severity: str = "severity", org: str = "org", doc_level: str = "doc_level") -> DataFrame:
    """(``measure``, ``grp``, ``n``, ``k``, ``share``) over all pairs; a measure that applies to none is not there. Null texts count as empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    found = measures(text(source), text(draft), F.col(register), F.col(severity), F.col(org), F.coalesce(F.col(doc_level), F.lit(False)))
    # Not bound by a lambda: what stands in one is interpreted, which costs more than the rows that do not apply.
    rows = pairs.select(F.explode(found).alias("m")).select("m.*")
    out = rows.where("applies").groupBy("measure", "grp").agg(F.count("*").alias("n"), F.count_if("holds").alias("k"))
    return out.withColumn("share", F.round(F.col("k") / F.col("n"), 6))


def loss_and_recall(items: DataFrame, recall: DataFrame, model: str = "model", error: str = "error") -> DataFrame:
    """(model, error, ``n``, ``loss``, ``recall``, ``readable``): how often each model made each error, beside how well the check finds it when it is planted.

    Never one score: a loss of zero says nothing where the check is blind, so ``readable`` is whether the recall is known and above
    zero. ``items`` has a boolean ``lost`` for each pair that could show the error; ``recall`` has each error once.
    """
    losses = items.groupBy(model, error).agg(F.count("*").alias("n"), F.round(F.avg(F.col("lost").cast("int")), 6).alias("loss"))
    known = recall.select(error, "recall")
    return losses.join(known, error, "left").withColumn("readable", F.coalesce(F.col("recall") > 0, F.lit(False))).select(model, error, "n", "loss", "recall", "readable")
