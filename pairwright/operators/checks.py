"""Fidelity checks: what a draft lost, inflated, invented or flipped of its source, each as an array of flags.

A check fails only with the exact strings that made it fail as evidence. That nothing was found is a
non-detection, never a proof.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    BANDS,
    OVERLAP_STOPWORDS,
    cosine,
    entities,
    holds,
    identifiers,
    joined,
    let,
    lines,
    marker_clause,
    none_of,
    numbers,
    sentences,
    severity,
    sorted_set,
    status,
    strip,
    token_overlap,
    word_count,
)

FLAG = "struct<check:string,level:string,message:string,evidence:array<string>>"
FLAGS = f"array<{FLAG}>"

# Caveat markers, hedges, actions, status patterns, contracts and audiences that results depend on.
CAVEAT_MARKERS = (
    "requires authenticat", "requires local access", "requires physical access", "requires user interaction",
    "only if", "only when", "in certain configurations", "under certain conditions", "no evidence of exploitation",
    "no evidence that", "not exploitable", "did not observe", "we did not find", "theoretical",
    "difficult to exploit", "mitigated by", "already patched", "requires admin", "requires elevated",
    "low likelihood", "unlikely to", "provided that", "as long as", "if an attacker", "would require",
)
HEDGE = r"(?iU)\b(?:could|may|might|can|would|potential\w*|possibl\w*|if\s+exploited|under\s+certain|in\s+theory|theoretically|is\s+able\s+to|be\s+able\s+to)\b"
ACTION = (
    r"(?iU)\b(?:allow\w*|enabl\w*|permit\w*|grant\w*|expos\w*|leak\w*|caus\w*|lead\w*|result\w*|access\w*|read\w*|writ\w*|execut\w*|compromis\w*|"
    r"bypass\w*|escalat\w*|steal|stole|stolen|disclos\w*|overwrit\w*|drain\w*|delet\w*|modif\w*|tamper\w*|impersonat\w*|spoof\w*|forg\w*|"
    r"hijack\w*|poison\w*|inject\w*|deface\w*|encrypt\w*|exfiltrat\w*|takeover|take\s+over|elevat\w*|manipulat\w*|corrupt\w*|redirect\w*)\b"
)
EXPLOITED = (
    r"(?iU)\b(?:was|were|has been|have been|is being|are being)\s+exploit\w*|attackers?\s+(?:accessed|stole|exfiltrat\w*|compromis\w*|drained|encrypted)|breach\s+occurred|"
    r"\b\w+\s+(?:was|were|have been|has been)\s+(?:stolen|exfiltrat\w*|breached|compromised|encrypted|leaked)|(?:already|successfully)\s+(?:stolen|exploited|breached|compromised|accessed)"
)
EXPLOITABLE = r"(?iU)\b(?:could|may|might|can)\s+(?:be\s+)?exploit\w*|an?\s+attacker\s+could|potential\w*\s+(?:for\s+)?exploit\w*|if\s+exploited"
#: One of these stands in every match of the pattern, in lower case.
EXPLOITED_SIGNS = ("was", "were", "been", "being", "stole", "exfiltrat", "compromis", "drained", "encrypted", "breach", "accessed", "already", "successfully")
REMEDIATED_SIGNS = ("fixed", "patched", "remediat", "resolved", "addressed", "mitigat", "no longer")
REMEDIATED = r"(?iU)\b(?:has been|was|is|are|were)\s+(?:fixed|patched|remediat\w*|resolved|addressed|mitigat\w*)|no longer\s+vulnerable"
VULNERABLE = r"(?iU)\b(?:is|are|remains?|still)\s+vulnerable|unpatched|unremediat\w*|not\s+(?:yet\s+)?(?:fixed|patched|remediat\w*)"
NOT_EXPLOITED = r"(?iU)\bno\s+(?:evidence|indication|sign)\s+of\s+(?:exploit\w*|compromis\w*|access|breach)"
CAVEAT_OVERLAP, CAVEAT_COSINE = 0.35, 0.55


@dataclass(frozen=True)
class Contract:
    """What a format asks for; None where it asks nothing."""

    label: str
    max_words: int | None = None
    bullets: int | None = None
    words_per_bullet: int | None = None


@dataclass(frozen=True)
class Audience:
    """A reader and the terms that need explaining to them."""

    label: str
    jargon: tuple[str, ...] = field(default=())


CONTRACTS = {
    "email": Contract("Email paragraph", max_words=150),
    "slide": Contract("Slide bullets", bullets=3, words_per_bullet=20),
    "one_pager": Contract("One-pager paragraph", max_words=180),
}
AUDIENCES = {
    "technical_leadership": Audience("Technical leadership"),
    "practitioner": Audience("Practitioner (engineer)"),
    "management": Audience("Board / senior management", ("ssrf", "xss", "csrf", "rce", "deserialization", "endpoint", "nonce", "heap", "buffer overflow", "privilege escalation")),
    "customer": Audience("Affected customers", ("ssrf", "xss", "csrf", "rce", "deserialization", "endpoint", "nonce", "heap", "privilege escalation")),
    "regulatory": Audience("Regulator / legal", ("ssrf", "xss", "csrf", "rce", "deserialization")),
    "public": Audience("General public", ("ssrf", "xss", "csrf", "rce", "deserialization", "endpoint", "nonce", "heap", "buffer overflow", "privilege escalation", "cve")),
}


def flag(check: str, level: str, message: str, evidence: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(level).alias("level"), F.lit(message).alias("message"), evidence.cast("array<string>").alias("evidence"))


def flag_if(condition: Column, check: str, level: str, message: str, evidence: Column) -> Column:
    """One flag, or none."""
    return F.when(condition, F.array(flag(check, level, message, evidence))).otherwise(none_of(FLAGS))


@dataclass(frozen=True)
class Facts:
    """What the checks look for in a text. ``of`` gives expressions; ``bound`` puts them into columns of their own, so that each is worked out once for all checks of a row."""

    text: Column
    identifiers: Column
    numbers: Column
    severity: Column
    entities: Column
    sentences: Column
    clauses: Column
    hedges: Column
    acts: Column
    exploited: Column
    exploitable: Column
    remediated: Column
    vulnerable: Column

    @classmethod
    def of(cls, text: Column | Facts, low: Column | None = None) -> Facts:
        """``low``: the text in lower case, if it is known."""
        if isinstance(text, Facts):
            return text
        low = F.lower(text) if low is None else low
        return cls(
            text, identifiers(text, low), numbers(text, low=low), severity(text, low), entities(text, low), sentences(text), caveat_clauses(text), holds(text, HEDGE, low), holds(text, ACTION, low),
            status(text, EXPLOITED, *EXPLOITED_SIGNS, low=low), status(text, EXPLOITABLE, "exploit", "attacker", low=low), status(text, REMEDIATED, *REMEDIATED_SIGNS, low=low),
            status(text, VULNERABLE, "vulnerable", "unpatched", "unremediat", "not", low=low),
        )

    @classmethod
    def bound(cls, rows: DataFrame, text: Column, prefix: str, wanted: dict[str, Column] | None = None) -> tuple[DataFrame, Facts]:
        """``rows`` with a column for each fact, named by ``prefix``, and the facts as these columns. With ``wanted``, a fact is looked for only in the rows where its condition there holds, and null in others."""
        names = [f.name for f in fields(cls)]
        some = lambda n, x: x if wanted is None else F.when(wanted.get(n, F.lit(False)), x)
        out = rows.withColumn(f"{prefix}text", text).withColumn(f"{prefix}low", F.lower(f"{prefix}text"))
        found = cls.of(F.col(f"{prefix}text"), F.col(f"{prefix}low"))
        out = out.withColumns({f"{prefix}{n}": some(n, getattr(found, n)) for n in names if n not in ("text", "clauses")})
        clauses = caveat_clauses(F.col(f"{prefix}text"), F.col(f"{prefix}sentences") if wanted is None else found.sentences)
        return out.withColumn(f"{prefix}clauses", some("clauses", clauses)), cls(*[F.col(f"{prefix}{n}") for n in names])


Text = Column | Facts


def id_parity(source: Text, draft: Text, omitted: Column) -> Column:
    """Identifiers of the source that are neither kept nor declared omitted."""
    missing = F.array_except(Facts.of(source).identifiers, F.array_union(Facts.of(draft).identifiers, identifiers(joined(omitted))))
    return let(F.array_sort(missing), lambda m: flag_if(F.size(m) > 0, "id_parity", "fail", "identifiers of the source neither kept nor declared omitted", m))


def numeric_parity(source: Text, draft: Text, omitted: Column) -> Column:
    """Numbers of the source that are neither kept nor declared omitted, as tokens or as mere digits."""
    source, draft, said = Facts.of(source), Facts.of(draft), joined(omitted)

    def missing(kept: Column) -> Column:
        return F.filter(source.numbers, lambda n: ~F.array_contains(kept, n) & ~F.contains(draft.text, n) & ~F.contains(said, n))

    lost = let(F.array_union(draft.numbers, numbers(said, skip_identifiers=False)), missing)
    return let(lost, lambda m: flag_if(F.size(m) > 0, "numeric_parity", "fail", "numbers of the source neither kept nor declared omitted", m))


def severity_drift(source: Text, draft: Text, declared: Column, both_ways: bool = False) -> Column:
    """Severity of the draft, or as declared, below the source's; not named at all (a warning); with ``both_ways`` also above."""
    claimed = F.coalesce(*[F.when(F.lower(declared) == n, F.lit(b)) for n, b in BANDS.items()])
    tag = lambda name, value: F.concat(F.lit(f"{name}: "), value)

    def compare(s: Column, d: Column) -> Column:
        told = F.array(tag("source", s["match"]), tag("draft", d["match"]))
        said = F.array(tag("declared", declared), tag("source", s["match"]))
        parts = [
            flag_if(d["band"] < s["band"], "severity_drift", "fail", "the draft's strongest severity is below the source's", told),
            flag_if(s.isNotNull() & d.isNull(), "severity_drift", "warn", "the source has a severity and the draft names none", F.array(tag("source", s["match"]))),
            flag_if(claimed < s["band"], "severity_drift", "fail", "the declared severity is below the source's", said),
        ]
        if both_ways:
            parts += [
                flag_if(d["band"] > s["band"], "severity_drift", "fail", "the draft's strongest severity is above the source's", told),
                flag_if(claimed > s["band"], "severity_drift", "fail", "the declared severity is above the source's", said),
            ]
        return F.concat(*parts)

    return let(Facts.of(source).severity, lambda s: let(Facts.of(draft).severity, lambda d: compare(s, d)))


def entity_check(source: Text, draft: Text, omitted: Column) -> Column:
    """Entities in the draft only: invented (fail). In the source only and not declared: dropped (a warning)."""

    def compare(s: Column, d: Column) -> Column:
        invented = F.array_sort(F.array_except(d, s))
        dropped = F.array_sort(F.array_except(s, F.array_union(d, entities(joined(omitted)))))
        return F.concat(
            flag_if(F.size(invented) > 0, "entity_check", "fail", "technical entities of the draft that the source does not have", invented),
            flag_if(F.size(dropped) > 0, "entity_check", "warn", "technical entities dropped without declaration", dropped),
        )

    return let(Facts.of(source).entities, lambda s: let(Facts.of(draft).entities, lambda d: compare(s, d)))


#: Any marker; a look at two letters passes over most places.
_MARKED = f"(?=[{''.join(sorted({m[0] for m in CAVEAT_MARKERS}))}][{''.join(sorted({m[1] for m in CAVEAT_MARKERS}))}])(?:{'|'.join(CAVEAT_MARKERS)})"


def caveat_clauses(source: Column, said: Column | None = None) -> Column:
    """Of each source sentence with a caveat marker, the clause around the first marker in the list's order; ``said`` are its sentences, if they are known."""
    said = sentences(source) if said is None else said
    clause = lambda s, m: F.when(s.rlike("[,;]| and "), marker_clause(s, m)).otherwise(s)
    marker = lambda s: let(F.lower(s), lambda low: F.when(low.rlike(_MARKED), F.coalesce(*[F.when(low.contains(m), F.lit(m)) for m in CAVEAT_MARKERS])))
    return F.filter(F.transform(said, lambda s: let(marker(s), lambda m: F.when(m.isNotNull(), clause(s, m)))), lambda c: c.isNotNull())


#: A word that is no stopword, in lower case.
_COUNTED = rf"(?<![a-z0-9'])(?!(?:{'|'.join(OVERLAP_STOPWORDS)})(?![a-z0-9']))[a-z0-9']"


def caveat_parity(source: Text, draft: Text, omitted: Column, threshold: float = CAVEAT_OVERLAP) -> Column:
    """Caveat clauses of the source of whose words no sentence of the draft, and no omission, has a share of ``threshold``."""

    def lost(heard: Column) -> Column:
        # A clause that is heard as it stands has all its words there (a share of 1), if it has any that counts.
        as_it_stands = lambda c: F.array_contains(heard, c) & (F.when(F.lower(c).rlike(_COUNTED), 1.0).otherwise(0.0) >= threshold)
        best = lambda c: F.coalesce(F.array_max(F.transform(heard, lambda h: token_overlap(c, h))), F.lit(0.0))
        return F.filter(Facts.of(source).clauses, lambda c: F.when(as_it_stands(c), F.lit(False)).otherwise(best(c) < threshold))

    heard = F.concat(Facts.of(draft).sentences, F.coalesce(omitted, none_of()))
    return F.transform(let(heard, lost), lambda c: flag("caveat_parity", "fail", "a condition of the source has no counterpart in the draft", F.array(c)))


def caveat_parity_vectors(clauses: Column, vectors: Column, heard: Column, threshold: float = CAVEAT_COSINE) -> Column:
    """The same with vectors: ``clauses`` with their ``vectors``, against the vectors ``heard`` of draft sentences and omissions."""
    best = lambda v: F.coalesce(F.array_max(F.transform(heard, lambda h: cosine(v, h))), F.lit(0.0))
    lost = F.filter(F.arrays_zip(clauses.alias("c"), vectors.alias("v")), lambda x: best(x["v"]) < threshold)
    return F.transform(lost, lambda x: flag("caveat_parity", "fail", "a condition of the source has no counterpart in the draft", F.array(x["c"])))


def claim_inflation(source: Text, draft: Text) -> Column:
    """The source hedges an action; the draft states one with no hedge anywhere. Evidence: the hedge, and the action with its surroundings."""
    source, said = Facts.of(source), Facts.of(draft)
    draft = said.text
    at = F.regexp_instr(draft, F.lit(ACTION))
    begin = F.greatest(at - 24, F.lit(1))
    around = F.substr(draft, begin, at + F.length(F.regexp_extract(draft, ACTION, 0)) + 16 - begin)
    fires = source.hedges & source.acts & ~said.hedges & said.acts
    evidence = F.array(F.concat(F.lit("source hedge: "), F.regexp_extract(source.text, HEDGE, 0)), F.concat(F.lit("draft: …"), strip(around), F.lit("…")))
    return flag_if(fires, "claim_inflation", "fail", "the source hedges the impact, the draft asserts it", evidence)


def claim_inflation_by_sentence(source: Column, draft: Column) -> Column:
    """The same for each draft sentence by itself, so that a hedge elsewhere does not excuse it."""
    bare = F.filter(sentences(draft), lambda s: s.rlike(ACTION) & ~s.rlike(HEDGE))
    return F.when(source.rlike(HEDGE) & source.rlike(ACTION), F.transform(bare, lambda s: flag("claim_inflation", "fail", "the source hedges the impact, a sentence of the draft asserts it", F.array(s)))).otherwise(none_of(FLAGS))


def status_drift(source: Text, draft: Text) -> Column:
    """From possible to actual exploitation (fail), from remediated to vulnerable (fail), from vulnerable to remediated (a warning)."""
    source, draft = Facts.of(source), Facts.of(draft)
    tag = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    only_possible = source.exploited.isNull() & (source.exploitable.isNotNull() | source.acts)
    return F.concat(
        let(draft.exploited, lambda a: flag_if(a.isNotNull() & only_possible, "status_drift", "fail", "the draft implies exploitation, the source only its possibility", F.array(tag("draft", a)))),
        let(source.remediated, lambda s: let(draft.vulnerable, lambda d: flag_if(s.isNotNull() & d.isNotNull(), "status_drift", "fail", "remediated in the source, still vulnerable in the draft", F.array(tag("source", s), tag("draft", d))))),
        let(draft.remediated, lambda d: flag_if(source.vulnerable.isNotNull() & d.isNotNull(), "status_drift", "warn", "the draft implies remediation that the source does not state", F.array(tag("draft", d)))),
    )


def negation_flip(source: Text, draft: Text) -> Column:
    """The source reports no evidence of exploitation; the draft asserts it."""
    return let(Facts.of(draft).exploited, lambda a: flag_if(a.isNotNull() & Facts.of(source).text.rlike(NOT_EXPLOITED), "negation_flip", "fail", "the source reports no evidence of exploitation, the draft asserts it", F.array(F.concat(F.lit("draft: "), a))))


def format_lint(draft: Column, contract: Column, audience: Column) -> Column:
    """Word limit, number and length of bullets (fail); unexplained jargon (a warning). Keys that are not known ask for nothing; ``unknown_keys`` finds them."""
    parts = []
    bullets = F.filter(lines(draft), lambda x: strip(x).rlike("^[-•*]"))
    for key, c in CONTRACTS.items():
        mine = F.coalesce(contract == key, F.lit(False))
        if c.max_words:
            parts.append(F.when(mine, _too_long(draft, mine, c)).otherwise(none_of(FLAGS)))
        if c.bullets:
            parts.append(F.when(mine, _bullets(bullets, mine, c)).otherwise(none_of(FLAGS)))
    for key, a in AUDIENCES.items():
        if a.jargon:
            mine = F.coalesce(audience == key, F.lit(False))
            parts.append(F.when(mine, _jargon(draft, mine, a)).otherwise(none_of(FLAGS)))
    return F.concat(*parts)


def _too_long(draft: Column, mine: Column, c: Contract) -> Column:
    return let(word_count(draft), lambda n: flag_if(mine & (n > c.max_words), "format_lint", "fail", f"more words than the {c.label} limit of {c.max_words}", F.array(F.concat(n.cast("string"), F.lit(" words")))))


def _bullets(bullets: Column, mine: Column, c: Contract) -> Column:
    def judge(b: Column) -> Column:
        number = flag_if(mine & (F.size(b) > 0) & (F.size(b) != c.bullets), "format_lint", "fail", f"the contract asks for exactly {c.bullets} bullets", F.array(F.concat(F.size(b).cast("string"), F.lit(" bullets"))))
        long = F.filter(b, lambda x: mine & (word_count(F.regexp_replace(x, "^[-•* ]+", "")) > (c.words_per_bullet or 1 << 30)))
        return F.concat(number, F.transform(long, lambda x: flag("format_lint", "fail", f"a bullet exceeds {c.words_per_bullet} words", F.array(strip(x)))))

    return let(bullets, judge)


def _jargon(draft: Column, mine: Column, a: Audience) -> Column:
    hits = F.filter(F.array(*[F.lit(t) for t in sorted(a.jargon)]), lambda t: F.contains(F.lower(draft), t))
    return let(hits, lambda h: flag_if(mine & (F.size(h) > 0), "format_lint", "warn", f"unexplained technical jargon for {a.label}", h))


def unknown_keys(contract: Column, audience: Column) -> Column:
    """Format and audience keys that are given but not defined."""
    wrong = lambda key, known: F.when(key.isNotNull() & ~key.isin(*known), key)
    return F.filter(F.array(wrong(contract, CONTRACTS), wrong(audience, AUDIENCES)), lambda x: x.isNotNull())


CHECKS = ("id_parity", "numeric_parity", "severity_drift", "entity_check", "caveat_parity", "claim_inflation", "status_drift", "negation_flip", "format_lint")


def all_checks(source: Text, draft: Text, omitted: Column, declared: Column, contract: Column, audience: Column, both_ways: bool = False) -> dict[str, Column]:
    """The flags of each check by its name."""
    return {
        "id_parity": id_parity(source, draft, omitted),
        "numeric_parity": numeric_parity(source, draft, omitted),
        "severity_drift": severity_drift(source, draft, declared, both_ways),
        "entity_check": entity_check(source, draft, omitted),
        "caveat_parity": caveat_parity(source, draft, omitted),
        "claim_inflation": claim_inflation(source, draft),
        "status_drift": status_drift(source, draft),
        "negation_flip": negation_flip(source, draft),
        "format_lint": format_lint(Facts.of(draft).text, contract, audience),
    }


def applicable(source: Text, draft: Text, contract: Column, audience: Column) -> Column:
    """The checks that had anything to look at; a check not among them has passed for want of matter."""
    s, d = Facts.of(source), Facts.of(draft)
    has = {
        "id_parity": F.size(s.identifiers) > 0,
        "numeric_parity": F.size(s.numbers) > 0,
        "severity_drift": s.severity.isNotNull(),
        "entity_check": (F.size(s.entities) > 0) | (F.size(d.entities) > 0),
        "caveat_parity": F.size(s.clauses) > 0,
        "claim_inflation": s.hedges & s.acts,
        "status_drift": d.exploited.isNotNull() | d.vulnerable.isNotNull() | d.remediated.isNotNull(),
        "negation_flip": s.text.rlike(NOT_EXPLOITED),
        "format_lint": contract.isNotNull() | audience.isNotNull(),
    }
    return F.filter(F.array(*[F.when(has[c], F.lit(c)) for c in CHECKS]), lambda x: x.isNotNull())


def _of_target(found: dict[str, Column], target: str) -> Column:
    """The flags of the check that the column ``target`` names."""
    out = none_of(FLAGS)
    for name, value in found.items():
        out = F.when(F.col(target) == name, value).otherwise(out)
    return out


def judge(pairs: DataFrame, source: str = "source_text", draft: str = "draft_text", omitted: str | None = None, declared: str | None = None, contract: str | None = None, audience: str | None = None, both_ways: bool = False, target: str | None = None, base: str | None = None) -> DataFrame:
    """``pairs`` with ``flags`` of all checks, ``passed`` (checks without a flag), ``applicable`` and ``ok`` (no flag fails).

    Projections only, no shuffle: the facts of both texts, then what the checks make of them. Null texts count as empty.
    With ``base``, a column of that name has the flags of the check that the column ``target`` names, of the source as a draft of itself.
    """
    col = lambda name, kind="string": F.col(name) if name else F.lit(None).cast(kind)
    rows, s = Facts.bound(pairs, F.coalesce(F.col(source), F.lit("")), "_source_")
    rows, d = Facts.bound(rows, F.coalesce(F.col(draft), F.lit("")), "_draft_")
    o, c, a = col(omitted, "array<string>"), col(contract), col(audience)
    found = all_checks(s, d, o, col(declared), c, a, both_ways)
    more = {base: _of_target(all_checks(s, s, o, col(declared), c, a, both_ways), target)} if base else {}
    out = rows.withColumns({"flags": F.concat(*found.values()), "applicable": applicable(s, d, c, a)} | more).select(*[x for x in pairs.columns if x not in ("flags", "applicable", "passed", "ok", base)], *more, "flags", "applicable")
    out = out.withColumn("passed", F.array_except(F.array(*[F.lit(n) for n in CHECKS]), F.transform("flags", lambda f: f["check"])))
    return out.withColumn("ok", ~F.exists("flags", lambda f: f["level"] == "fail"))


#: The facts of source and draft that each check looks at.
_LOOKS_AT = {
    "id_parity": (("identifiers",), ("identifiers",)), "numeric_parity": (("numbers",), ("numbers",)), "severity_drift": (("severity",), ("severity",)), "entity_check": (("entities",), ("entities",)), "caveat_parity": (("clauses",), ("sentences",)),
    "claim_inflation": (("hedges", "acts"), ("hedges", "acts")), "status_drift": (("exploited", "exploitable", "acts", "remediated", "vulnerable"), ("exploited", "remediated", "vulnerable")), "negation_flip": ((), ("exploited",)), "format_lint": ((), ()),
}


def judge_one(pairs: DataFrame, target: str, source: str = "source_text", draft: str = "draft_text", omitted: str | None = None, declared: str | None = None, contract: str | None = None, audience: str | None = None, both_ways: bool = False, base: str | None = None) -> DataFrame:
    """``pairs`` with ``flags`` of that check only which the column ``target`` names; the others are not evaluated, nor the facts that only they look at.

    With ``base``, a column of that name has the flags of the source as a draft of itself, by the same facts.
    """
    col = lambda name, kind="string": F.col(name) if name else F.lit(None).cast(kind)

    def wanted(side: int) -> dict[str, Column]:
        of = lambda name: [c for c, facts in _LOOKS_AT.items() if name in facts[side] or (base and not side and name in facts[1])]
        return {f.name: F.col(target).isin(*of(f.name)) for f in fields(Facts) if of(f.name)}

    rows, s = Facts.bound(pairs, F.coalesce(F.col(source), F.lit("")), "_source_", wanted(0))
    rows, d = Facts.bound(rows, F.coalesce(F.col(draft), F.lit("")), "_draft_", wanted(1))

    flags = lambda said: _of_target(all_checks(s, said, col(omitted, "array<string>"), col(declared), col(contract), col(audience), both_ways), target)
    return rows.withColumns({"flags": flags(d)} | ({base: flags(s)} if base else {})).select(*[c for c in pairs.columns if c not in ("flags", base)], "flags", *([base] if base else []))


def sentence_levels(source: Text, draft: Column) -> Column:
    """Each draft sentence as ``struct<sentence, level, checks>``: red where a claim, status or negation check fails for it alone, amber where one warns, else green."""

    def level(s: Column) -> Column:
        found = F.concat(claim_inflation(source, s), status_drift(source, s), negation_flip(source, s))
        worst = lambda f: F.when(F.exists(f, lambda x: x["level"] == "fail"), "red").when(F.size(f) > 0, "amber").otherwise("green")
        return let(found, lambda f: F.struct(s.alias("sentence"), worst(f).alias("level"), sorted_set(F.transform(f, lambda x: x["check"])).alias("checks")))

    return F.transform(sentences(draft), level)


def sentence_rows(pairs: DataFrame, id: str, source: str = "source_text", draft: str = "draft_text") -> DataFrame:
    """(id, ``n``, ``sentence``, ``level``, ``checks``): ``sentence_levels`` with a row for each draft sentence, numbered from 0. The facts of a source are found once, those of a sentence in columns of its row."""
    told = ("hedges", "acts", "exploited", "exploitable", "remediated", "vulnerable")
    rows, s = Facts.bound(pairs, F.coalesce(F.col(source), F.lit("")), "_source_")
    rows = rows.withColumn("_said", sentences(F.coalesce(F.col(draft), F.lit(""))))
    rows = rows.select(id, "_source_text", *[f"_source_{n}" for n in told], F.posexplode_outer("_said").alias("n", "sentence")).where("sentence is not null")
    rows, d = Facts.bound(rows, F.col("sentence"), "_draft_")
    rows = rows.withColumn("_found", F.concat(claim_inflation(s, d), status_drift(s, d), negation_flip(s, d)))
    level = F.when(F.size("_found") == 0, "green").when(F.exists("_found", lambda x: x["level"] == "fail"), "red").otherwise("amber")
    return rows.select(id, F.col("n").cast("bigint").alias("n"), "sentence", level.alias("level"), F.when(F.size("_found") == 0, none_of()).otherwise(sorted_set(F.transform("_found", lambda x: x["check"]))).alias("checks"))


def _best_finding(findings: Column, sentence: Column) -> Column:
    """Of a draft's findings the one that has most of the sentence's words, the first on a tie."""
    scored = F.transform(findings, lambda x, i: F.struct(token_overlap(sentence, x["text"]).alias("score"), (-i).alias("i")))
    return F.when(F.size(findings) == 1, F.get(findings, F.lit(0))).otherwise(F.get(findings, -F.array_max(scored)["i"]))


def _asserted(sentence: Column, finding: Column) -> Column:
    """A sentence as ``struct<sentence, ref, level, checks>`` by what its finding says."""
    none = F.lit(None)
    own = Facts(finding["text"], none, none, none, none, none, none, *[finding[n] for n in ("hedges", "acts", "exploited", "exploitable", "remediated", "vulnerable")])
    flags = F.concat(claim_inflation(own, sentence), status_drift(own, sentence), negation_flip(own, sentence))

    def told(f: Column) -> Column:
        red = F.exists(f, lambda x: (x["level"] == "fail") & (x["check"] != "claim_inflation"))
        level = F.when(red, "red").when(F.size(f) > 0, "amber").otherwise("green")
        return F.struct(sentence.alias("sentence"), finding["ref"].alias("ref"), level.alias("level"), sorted_set(F.transform(f, lambda x: x["check"])).alias("checks"))

    return let(flags, told)


def draft_review(findings: DataFrame, drafts: DataFrame, id: str = "report_id", ref: str = "ref", source: str = "source_text", draft: str = "draft_text") -> DataFrame:
    """A row per draft of ``drafts(id, draft)``, reviewed against all its ``findings(id, ref, source)``.

    Coverage, once for the whole draft: identifiers, numbers and conditions left out, and entities dropped, are
    warnings, for leaving out can be meant; a severity that is lowered or an entity that is invented stays a fail.
    Assertion, for each sentence against the finding whose words it has most of (the first on a tie): a lost hedge
    is amber, what else the claim, status and negation checks find is red where it fails. ``coverage`` has the
    flags, ``sentences`` a struct each (``sentence``, ``ref``, ``level``, ``checks``); then ``green``, ``amber``,
    ``red`` and ``worst``. A draft without findings is none.
    """
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    # What an assertion is held against is found once for a finding, not for each sentence; no text is shuffled but to meet its draft.
    own, f = Facts.bound(findings, text(source), "_own_")
    facts = [c.alias(n) for n, c in (("text", f.text), ("hedges", f.hedges), ("acts", f.acts), ("exploited", f.exploited), ("exploitable", f.exploitable), ("remediated", f.remediated), ("vulnerable", f.vulnerable))]
    grouped = own.groupBy(id).agg(F.array_sort(F.collect_list(F.struct(F.col(ref).alias("ref"), *facts))).alias("_findings"))
    rows, s = Facts.bound(grouped, F.array_join(F.transform("_findings", lambda x: x["text"]), "\n\n"), "_source_")
    rows, d = Facts.bound(drafts.select(id, text(draft).alias("_draft")).join(rows, id), F.col("_draft"), "_draft_")
    nothing = F.lit(None).cast("array<string>")
    milder = lambda flags, all: F.transform(flags, lambda f: f.withField("level", F.when(all | (f["level"] == "warn"), "warn").otherwise(f["level"])))
    coverage = F.concat(
        milder(id_parity(s, d, nothing), F.lit(True)), milder(numeric_parity(s, d, nothing), F.lit(True)), severity_drift(s, d, F.lit(None).cast("string")), entity_check(s, d, nothing), milder(caveat_parity(s, d, nothing), F.lit(True)),
    )
    said = lambda: F.transform(d.sentences, lambda x: let(_best_finding(F.col("_findings"), x), lambda best: _asserted(x, best)))
    out = rows.select(id, coverage.alias("coverage"), F.when(F.size(d.sentences) > 0, said()).alias("sentences"))
    count = lambda level: F.size(F.filter(F.coalesce("sentences", F.array()), lambda x: x["level"] == level)).alias(level)
    covered = F.when(F.exists("coverage", lambda f: f["level"] == "fail"), "red").when(F.size("coverage") > 0, "amber").otherwise("green")
    worst = worst_level(F.concat(F.array(covered), F.coalesce(F.transform("sentences", lambda x: x["level"]), none_of())))
    return out.select(id, "coverage", "sentences", count("green"), count("amber"), count("red"), worst.alias("worst"))


def tinted(draft: Column, flags: Column) -> Column:
    """Each draft sentence as ``struct<sentence, level>``: red or amber where the evidence of a failing or warning flag stands in it."""
    bare = lambda e: F.regexp_replace(e, "^(?:draft|source|declared|source hedge): |…", "")
    inside = lambda s, kind: F.exists(flags, lambda f: (f["level"] == kind) & F.exists(f["evidence"], lambda e: (F.length(bare(e)) > 0) & F.contains(F.lower(s), F.lower(bare(e)))))
    return F.transform(sentences(draft), lambda s: F.struct(s.alias("sentence"), F.when(inside(s, "fail"), "red").when(inside(s, "warn"), "amber").otherwise("ok").alias("level")))


def worst_level(levels: Column) -> Column:
    """The worst of green, amber and red."""
    rank = F.array_max(F.transform(levels, lambda x: F.when(x == "red", 2).when(x == "amber", 1).otherwise(0)))
    return F.when(rank == 2, "red").when(rank == 1, "amber").otherwise("green")


def document_checks(text: Column, pages: Column, tables: Column, findings_heading: str = r"(?im)^#{1,4}.*(?:findings|vulnerabilit|results)", summary_heading: str = r"(?im)^#{1,4}.*(?:executive|summary)") -> dict[str, Column]:
    """Named tests of a parsed document: density of characters per page, share of broken characters, headings, degenerate tables, and a severity word."""
    per_page = F.length(text) / F.greatest(pages, F.lit(1))
    broken = F.regexp_count(text, F.lit("�|Ã.|â€")) / F.greatest(F.length(text), F.lit(1))
    poor = F.filter(tables, lambda t: (t["num_cols"] < 2) | (t["num_rows"] < 2) | (t["empty_cell_frac"] > 0.6))
    return {
        "chars_per_page": per_page.between(400, 8000),
        "mojibake": broken < 0.001,
        "summary_heading": text.rlike(summary_heading),
        "findings_heading": text.rlike(findings_heading),
        "tables": F.when(F.size(tables) > 0, F.size(poor) / F.size(tables) <= 0.5).otherwise(F.lit(True)),
        "severity_word": text.rlike(r"(?i)\b(?:critical|high|medium|low|informational)\b"),
    }

