"""Column builders for text: tokens, identifiers, numbers, severity, status, sentences, overlap and normal forms.

Regular expressions are literals and use ``(?U)`` where word, space and digit classes are meant for all of Unicode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of identifiers, entities, numbers and severity that results depend on.
ID_PATTERNS = (
    r"(?iU)\bCVE-\d{4}-\d{4,7}\b",
    r"(?iU)\bCWE-\d{1,4}\b",
    r"(?iU)\bGHSA-[a-z0-9]{4}-[a-z0-9]{4}-[a-z0-9]{4}\b",
    r"(?iU)\bICSA-\d{2}-\d{3}-\d{2}\b",
    r"(?U)\b(?:TOB|DYL|PBL|NCC|KL|OSTIF)-[A-Z0-9]{2,12}-\d{1,4}\b",
)
IP_PATTERN = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
VERSION_PATTERN = r"(?U)\bv?\d+\.\d+(?:\.\d+){1,3}\b"
DOMAIN_PATTERN = r"(?iU)\b[a-z0-9][a-z0-9-]{1,62}(?:\.[a-z0-9][a-z0-9-]{1,62})+\.(?:com|net|org|io|gov|edu|dev|co|us|uk|de|cloud)\b"
PORT_PATTERN = r"(?iU)\bport\s+(\d{2,5})\b"
NUMBER_PATTERN = r"(?U)(?<![\w.-])(\$?\d{1,3}(?:,\d{3})+(?:\.\d+)?|\$?\d+\.\d+|\$\d+|\d+(?:\.\d+)?\s?%|\d{4,6}|\b\d+\b)"
YEAR_PATTERN = r"^(19|20)\d{2}$"
SEVERITY_PATTERNS = (
    (r"(?iU)\bcritical\b", 4),
    (r"(?iU)\bhigh(?:[-\s]severity| risk| impact)?\b", 3),
    (r"(?iU)\b(?:actively exploited|exploit\w*\s+in the wild|exploitation observed)\b", 4),
    (r"(?iU)\bmedium\b|\bmoderate\b", 2),
    (r"(?iU)\blow(?:[-\s]severity| risk)?\b", 1),
    (r"(?iU)\binformational\b|\binfo\b", 0),
)
CVSS_PATTERN = r"(?iU)\bCVSS(?:\s*v?\d(?:\.\d)?)?\s*(?:base\s*)?(?:score\s*)?(?:of\s*)?[:\s]\s*(\d{1,2}(?:\.\d)?)"
CVSS_BANDS = ((9.0, 4), (7.0, 3), (4.0, 2))
BANDS = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
NEGATOR_PATTERN = r"(?iU)\b(?:no evidence|no indication|no sign|not been|have not|has not|was not|were not|without any|not observed|not aware|not exploit)\b"
OVERLAP_STOPWORDS = ("the", "a", "an", "of", "to", "and", "in", "is", "that", "this", "for", "on", "be", "by", "it", "as", "with")
EMAIL_PATTERN = r"(?U)[\w.+-]+@[\w-]+\.[\w.]+"

STRINGS = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def none_of(kind: str = STRINGS) -> Column:
    """An empty array."""
    return F.array().cast(kind)


def strip(text: Column) -> Column:
    """Without any Unicode white space around it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def may_hold(text: Column, *signs: str) -> Column:
    """Whether one of ``signs`` (lower case) stands in the text, whatever its case: a cheap test before a search. Texts with letters beyond ASCII, which fold in ways of their own, always pass."""
    low, found = F.lower(text), F.octet_length(text) != F.length(text)
    for sign in signs:
        found = found | low.contains(sign)
    return found


def is_ascii(text: Column) -> Column:
    """Whether every character is one of ASCII; over such texts a pattern without Unicode classes finds what it finds with them, and much faster."""
    return F.octet_length(text) == F.length(text)


def bare(pattern: str) -> str:
    """The pattern without Unicode classes, for ASCII texts."""
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "")


def bare_low(pattern: str) -> str:
    """The pattern without flags, for lower-cased ASCII texts; its letters must be small."""
    return pattern.replace("(?iU)", "")


def holds(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether ``pattern``, which begins with ``(?iU)`` and has small letters only, is in the text; ``low`` is the text in lower case, if it is known."""
    return F.when(is_ascii(text), (F.lower(text) if low is None else low).rlike(bare_low(pattern))).otherwise(text.rlike(pattern))


def _any(low: Column, signs) -> Column:
    found = F.lit(False)
    for sign in signs:
        found = found | low.contains(sign)
    return found


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def sorted_set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def joined(omitted: Column) -> Column:
    return F.array_join(F.coalesce(omitted, none_of()), " ")


# --- identifiers, entities, numbers ---

#: What stands in every match of each of ID_PATTERNS, in upper case: texts without it need no search.
_ID_SIGNS = ((("CVE-",), ("CWE-",), ("GHSA-",), ("ICSA-",), ("TOB-", "DYL-", "PBL-", "NCC-", "KL-", "OSTIF-")))


def identifiers(text: Column, low: Column | None = None) -> Column:
    """The sorted set of identifiers, in upper case."""
    low = F.lower(text) if low is None else low

    def found(upper: Column) -> Column:
        has = lambda signs: F.greatest(*[upper.contains(s) for s in signs], F.lit(False))
        return F.concat(*[F.when(has(signs), matches(text, p)).otherwise(none_of()) for p, signs in zip(ID_PATTERNS, _ID_SIGNS, strict=True)])

    parts = [F.when(_any(low, [x.lower() for x in signs]), matches(F.upper(text) if p.startswith("(?i") else text, bare(p))).otherwise(none_of()) for p, signs in zip(ID_PATTERNS, _ID_SIGNS, strict=True)]
    plain = F.sort_array(F.array_distinct(F.concat(*parts)))
    any_text = sorted_set(F.transform(let(F.upper(text), found), F.upper))
    return F.when(text.contains("-"), F.when(is_ascii(text), plain).otherwise(any_text)).otherwise(F.when(text.isNotNull(), none_of()))


#: One of these stands in every match of DOMAIN_PATTERN, in lower case.
_DOMAIN_SIGNS = (".com", ".net", ".org", ".io", ".gov", ".edu", ".dev", ".co", ".us", ".uk", ".de", ".cloud")


#: Two dots among digits stand in every address and version.
_DOTTED = r"[0-9]\.[0-9]+\.[0-9]"


def entities(text: Column, low: Column | None = None) -> Column:
    """The sorted set of addresses, versions, domains (lower case) and ``port N``."""
    low = F.lower(text) if low is None else low
    named = lambda numbers: F.transform(numbers, lambda n: F.concat(F.lit("port "), n))
    dotted = F.when(text.contains("."), F.concat(matches(text, IP_PATTERN), matches(text, VERSION_PATTERN))).otherwise(none_of())
    domains = F.when(may_hold(text, *_DOMAIN_SIGNS), matches(text, DOMAIN_PATTERN)).otherwise(none_of())
    ports = F.when(may_hold(text, "port"), named(matches(text, PORT_PATTERN, 1))).otherwise(none_of())
    any_text = sorted_set(F.concat(F.transform(F.concat(dotted, domains), F.lower), ports))
    plain = F.concat(
        F.when(text.rlike(_DOTTED), F.concat(matches(text, bare(IP_PATTERN)), matches(text, bare(VERSION_PATTERN)))).otherwise(none_of()),
        F.when(_any(low, _DOMAIN_SIGNS), matches(low, bare_low(DOMAIN_PATTERN))).otherwise(none_of()), F.when(low.contains("port"), named(matches(low, bare_low(PORT_PATTERN), 1))).otherwise(none_of()),
    )
    return F.when(is_ascii(text), F.sort_array(F.array_distinct(plain))).otherwise(F.when(text.isNotNull(), any_text))


def _without(pattern: str, signs: list[str]) -> Callable[[Column], Column]:
    return lambda text: F.when(may_hold(text, *signs), F.regexp_replace(text, pattern, "X")).otherwise(text)


#: A match begins with a digit or a dollar: all other places are passed over by one look.
_NUMBER_SEARCH = NUMBER_PATTERN.replace("(?U)", r"(?U)(?=[$\d])")


def _clean(rest: Column, search: str) -> Column:
    kept = F.filter(matches(rest, search), lambda t: ~t.rlike(YEAR_PATTERN))
    bare_number = lambda t: F.regexp_replace(F.regexp_replace(F.translate(t, ",  ", ""), r"^\$+", ""), r"%+$", "")
    plain = F.transform(kept, lambda t: F.when(t.rlike("^[0-9.]+$"), t).otherwise(bare_number(t)))
    return F.sort_array(F.array_distinct(F.filter(plain, lambda n: ~n.isin("1", "2"))))


def numbers(text: Column, skip_identifiers: bool = True, low: Column | None = None) -> Column:
    """The sorted set of numbers without ``,``, ``$`` and ``%``; bare years, 1 and 2 are none, nor is what stands inside an identifier, version or address."""
    low = F.lower(text) if low is None else low
    rest = plain = text
    if skip_identifiers:
        for p, signs in zip(ID_PATTERNS, _ID_SIGNS, strict=True):
            rest, plain = let(rest, _without(p, [x.lower() for x in signs])), F.regexp_replace(plain, bare(p), "X")
        rest = F.when(text.contains("-"), rest).otherwise(text)
        rest = let(rest, lambda r: F.when(r.contains("."), F.regexp_replace(F.regexp_replace(r, VERSION_PATTERN, "X"), IP_PATTERN, "X")).otherwise(r))
        # What is put in never makes a sign, so the signs of the whole text tell which patterns can be left out.
        rare, common = [x.lower() for signs in _ID_SIGNS[1:] for x in signs], F.when(low.contains("cve-"), F.regexp_replace(text, bare(ID_PATTERNS[0]), "X")).otherwise(text)
        plain = F.when(text.contains("-"), F.when(_any(low, rare), plain).otherwise(common)).otherwise(text)
        plain = F.when(text.rlike(_DOTTED), F.regexp_replace(F.regexp_replace(plain, bare(VERSION_PATTERN), "X"), bare(IP_PATTERN), "X")).otherwise(plain)
    found = F.when(is_ascii(text), F.when(text.rlike("[0-9]"), _clean(plain, bare(_NUMBER_SEARCH))).otherwise(none_of()))
    return found.otherwise(F.when(text.rlike(r"(?U)\d"), _clean(rest, _NUMBER_SEARCH)).otherwise(F.when(text.isNotNull(), none_of())))


# --- severity and status ---


def before_match(text: Column, pattern: str) -> Column:
    """What stands before the first match; the text where there is none."""
    return let(F.regexp_instr(text, F.lit(pattern)), lambda at: F.when(at > 0, F.left(text, at - 1)).otherwise(text))


def negated_before(text: Column, pattern: str) -> Column:
    """Whether a negator stands between the last full stop or line break and the first match."""
    # A search for "[^.\n]*$" would start anew at each character; a line break at the very end is none, as for that pattern.
    before = let(before_match(text, pattern), lambda t: F.when(t.endswith("\n"), F.left(t, F.length(t) - 1)).otherwise(t))
    return F.substring_index(F.translate(before, "\n", "."), ".", -1).rlike(NEGATOR_PATTERN)


#: One of these stands in every match of each of SEVERITY_PATTERNS, in lower case.
_SEVERITY_SIGNS = (("critical",), ("high",), ("actively exploited", "in the wild", "exploitation observed"), ("medium", "moderate"), ("low",), ("info",))


def severity(text: Column, low: Column | None = None) -> Column:
    """The strongest severity signal as ``struct<band, match>``, or null: the first hit of each pattern that is not negated, and every CVSS score; the earlier pattern wins a tie."""
    low = F.lower(text) if low is None else low
    kind = "array<struct<band:int,rank:int,match:string>>"

    def first_hit(pattern: str, band: int, rank: int) -> Column:
        hits = F.filter(F.split(text, r"[.\n]"), lambda s: s.rlike(pattern) & ~before_match(s, pattern).rlike(NEGATOR_PATTERN))
        found = F.transform(F.slice(hits, 1, 1), lambda s: F.struct(F.lit(band).alias("band"), F.lit(-rank).alias("rank"), F.regexp_extract(s, pattern, 0).alias("match")))
        return F.when(may_hold(text, *_SEVERITY_SIGNS[rank]) & text.rlike(pattern), found.cast(kind)).otherwise(none_of(kind))

    found = [first_hit(pattern, band, rank) for rank, (pattern, band) in enumerate(SEVERITY_PATTERNS)]
    score = F.arrays_zip(matches(text, CVSS_PATTERN).alias("m"), matches(text, CVSS_PATTERN, 1).alias("s"))

    def scored(x: Column, i: Column) -> Column:
        value, band = x["s"].cast("double"), F.lit(1)
        for least, b in reversed(CVSS_BANDS):
            band = F.when(value >= least, b).otherwise(band)
        return F.struct(band.alias("band"), (-i - len(SEVERITY_PATTERNS)).alias("rank"), x["m"].alias("match"))

    found.append(F.when(may_hold(text, "cvss") & text.rlike("(?iU)CVSS"), F.transform(score, scored).cast(kind)).otherwise(none_of(kind)))
    best = F.array_max(F.concat(*found))
    any_text = let(best, lambda b: F.when(b.isNotNull(), F.struct(b["band"].alias("band"), b["match"].alias("match"))))

    def told(rank: int) -> Column:
        # A first match with no negator anywhere before it is the first hit; lines do not matter where there is one only.
        pattern, band = SEVERITY_PATTERNS[rank]
        unsaid = ~F.left(low, F.regexp_instr(low, F.lit(bare_low(pattern))) - 1).rlike(bare_low(NEGATOR_PATTERN))
        slow = F.get(F.transform(first_hit(pattern, band, rank), lambda x: x["match"]), F.lit(0))
        match = F.when(unsaid, F.regexp_extract(text, bare(pattern), 0)).otherwise(slow)
        return F.when(_any(low, _SEVERITY_SIGNS[rank]) & low.rlike(bare_low(pattern)), F.when(match.isNotNull(), F.struct(F.lit(band).alias("band"), match.alias("match"))))

    strongest_first = sorted(range(len(SEVERITY_PATTERNS)), key=lambda rank: (-SEVERITY_PATTERNS[rank][1], rank))
    return F.when(is_ascii(text) & ~low.contains("cvss") & ~text.contains("\n"), F.coalesce(*map(told, strongest_first))).otherwise(any_text)


def status(text: Column, pattern: str, *signs: str, low: Column | None = None) -> Column:
    """The first match unless it is negated, else null. One of ``signs`` (lower case) must stand in every match; texts without them are not searched. The pattern's letters are small."""
    low = F.lower(text) if low is None else low
    could = may_hold(text, *signs) if signs else F.lit(True)
    any_text = F.when(could & text.rlike(pattern), F.when(~negated_before(text, pattern), F.regexp_extract(text, pattern, 0)))
    before = F.substring_index(F.left(low, F.regexp_instr(low, F.lit(bare_low(pattern))) - 1), ".", -1)
    plain = F.when((_any(low, signs) if signs else F.lit(True)) & low.rlike(bare_low(pattern)), F.when(~before.rlike(bare_low(NEGATOR_PATTERN)), F.regexp_extract(text, bare(pattern), 0)))
    return F.when(is_ascii(text) & ~text.contains("\n"), plain).otherwise(any_text)


# --- sentences, words, overlap ---


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!``, ``?`` and at line breaks; blanks are none."""
    any_text = F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")
    # Of an ASCII text in one line, with no white space but spaces and none at its ends, every part is a sentence as it stands.
    return F.when(is_ascii(text) & (F.octet_length(text) > 0) & (text == F.trim(text)) & ~text.rlike(r"[\t-\r]"), F.split(text, "(?<=[.!?]) +")).otherwise(any_text)


def prose_sentences(text: Column, least: int = 21) -> Column:
    """Split at a full stop before a capital or bracket, but not after an initial or abbreviation; at least ``least`` characters."""
    parts = F.split(squeezed(text), r"(?<!\b[A-Z])(?<!\bDr)(?<!\be\.g)(?<!\bi\.e)(?<!\bvs)\.\s+(?=[A-Z(])")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) >= least)


def block_sentences(text: Column, least: int = 26) -> Column:
    """Split after a terminator before a capital or digit; at least ``least`` characters."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])"), strip), lambda s: F.length(s) >= least)


def word_count(text: Column) -> Column:
    return F.size(matches(text, r"(?U)\S+"))


def lines(text: Column) -> Column:
    return F.split(text, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]")


def overlap_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9']+"), F.lit(0)))


def token_overlap(a: Column, b: Column) -> Column:
    """The share of the words of ``a`` that stand in ``b``, stopwords apart; 0 where either has no word."""
    stop = F.array(*[F.lit(w) for w in OVERLAP_STOPWORDS])

    def share(x: Column, y: Column) -> Column:
        kept = F.array_except(x, stop)
        return F.when((F.size(x) == 0) | (F.size(y) == 0) | (F.size(kept) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(kept, y)) / F.size(kept))

    return let(overlap_tokens(a), lambda x: let(overlap_tokens(b), lambda y: share(x, y)))


def significant_words(text: Column, stopwords: tuple[str, ...] = OVERLAP_STOPWORDS, least: int = 4) -> Column:
    """Distinct lower-case words of at least ``least`` letters that are no stopwords."""
    return F.filter(F.array_distinct(matches(F.lower(text), r"[a-z]+")), lambda w: (F.length(w) >= least) & ~w.isin(*stopwords))


def index_terms(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Terms of the lexical index, with repeats: ``[a-z][a-z0-9]{2,}`` in lower case."""
    terms = matches(F.lower(text), r"[a-z][a-z0-9]{2,}")
    return F.filter(terms, lambda t: ~t.isin(*stopwords)) if stopwords else terms


def word_shingles(text: Column, width: int = 3, pattern: str = r"(?U)\w+") -> Column:
    """Distinct runs of ``width`` words; the whole text where it has fewer."""

    def cut(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) >= width, F.array_distinct(grams)).otherwise(F.array(F.array_join(w, " ")))

    return let(matches(F.lower(text), pattern), cut)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def marker_clause(sentence: Column, marker: Column) -> Column:
    """The first part between commas, semicolons and `` and `` that holds the marker, else the sentence."""
    parts = F.filter(F.split(sentence, r"[,;]| and "), lambda c: F.contains(F.lower(c), marker))
    return F.coalesce(strip(F.get(parts, F.lit(0))), sentence)


# --- normal forms ---


def compact(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def padded(text: Column) -> Column:
    """Lower-case words with one space between and around them, for phrase search."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def canonical(text: Column) -> Column:
    """Curly quotes, dashes, special spaces and runs of white space made plain."""
    plain = F.translate(text, "‘’‚‛“”„–—−‐‑   ", "''''\"\"\"-----   ")
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def squeezed(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clip_at_word(text: Column, limit: int, keep: float = 0.6) -> Column:
    """``struct<text, cut>``: at most ``limit`` characters, back to the last space if that keeps more than ``keep`` of them."""

    def cut(head: Column) -> Column:
        last = F.length(head) - F.instr(F.reverse(head), " ")
        back = (F.instr(head, " ") > 0) & (last > F.lit(keep * limit))
        return F.struct(F.rtrim(F.when(back, F.left(head, last.cast("int"))).otherwise(head)).alias("text"), F.lit(True).alias("cut"))

    whole = F.struct(text.alias("text"), F.lit(False).alias("cut"))
    return F.when(F.length(text) <= limit, whole).otherwise(let(F.left(text, F.lit(limit)), cut))


def head_and_tail(text: Column, limit: int, mark: str = "\n[...]\n") -> Column:
    half = limit // 2
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit(mark), F.right(text, F.lit(half)))).otherwise(text)


def token_estimate(text: Column) -> Column:
    """Words times 1.3, to the nearest even at .5, at least 1."""
    return F.greatest(F.lit(1), F.bround(word_count(text) * F.lit(1.3)).cast("int"))


def is_quantified(text: Column) -> Column:
    """Whether a number of two digits stands in the text, or one digit near a unit of quantity."""
    return text.rlike(r"\d{2,}|\d.{0,30}(?:percent|%|million|billion|days|hours|systems|users|records)")


def has_email(text: Column, limit: int | None = None) -> Column:
    """Whether an e-mail address stands in the text; with ``limit``, in that many of its first characters."""
    return (F.left(text, F.lit(limit)) if limit else text).rlike(EMAIL_PATTERN)


def first_json_object(text: Column) -> Column:
    """The outermost braces of a reply, fences or prose around them aside; null without."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


# --- spans and quotes ---


def holds_verbatim(text: Column, quote: Column, least: int = 8) -> Column:
    """Whether the quote stands in the text, but for white space."""
    return (F.length(squeezed(quote)) >= least) & F.contains(squeezed(text), squeezed(quote))


def verbatim_slice(text: Column, quote: Column, least: int = 8) -> Column:
    """The literal slice of ``text`` that equals ``quote`` but for white space, or null: found by the quote's words, taken literally, with any space between."""
    words = F.regexp_replace(squeezed(quote), r"([^\p{L}\p{N}\s])", r"\\$1")
    rx = F.concat(F.lit("(?U)"), F.replace(words, F.lit(" "), F.lit("\\s+")))
    return F.when((F.length(squeezed(quote)) >= least) & F.regexp_like(text, rx), F.regexp_substr(text, rx))


def verified_span(text: Column, quote: Column, least: int = 8) -> Column:
    """``struct<start, stop>`` (from 0, in characters of ``text`` as it is) of the first place that equals ``quote`` but for white space; null where there is none.

    The slice found is literal, and its first place is that of the match: any earlier one would have matched as well.
    """
    return let(verbatim_slice(text, quote, least), lambda s: F.when(s.isNotNull(), let(F.call_function("locate", s, text), lambda at: F.struct((at - 1).alias("start"), (at - 1 + F.length(s)).alias("stop")))))


def quote_match(text: Column, quote: Column) -> Column:
    """How an elided quote (parts between ``...`` or ``…``) stands in the text: verbatim, ordered, unordered or none."""
    whole = squeezed(F.lower(text))
    parts = F.filter(F.transform(F.split(F.lower(quote), r"\.\.\.|…|\[\.\.\.\]"), squeezed), lambda s: s != "")

    def judge(p: Column) -> Column:
        step = lambda at, s: F.when(at < 0, at).otherwise(let(F.call_function("locate", s, whole, at), lambda k: F.when(k == 0, F.lit(-1)).otherwise(k + F.length(s))))
        ordered = F.aggregate(p, F.lit(1), step) > 0
        return F.when(F.size(p) == 0, "none").when(F.contains(whole, squeezed(F.lower(quote))), "verbatim").when(ordered, "ordered").when(F.forall(p, lambda s: F.contains(whole, s)), "unordered").otherwise("none")

    return let(parts, judge)


# --- vectors ---


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def softmax(scores: Column) -> Column:
    """Of an array of scores, stable for large ones."""
    return let(F.array_max(scores), lambda m: let(F.transform(scores, lambda s: F.exp(s - m)), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))))


# --- numbers in order ---


def run_lengths(sorted_numbers: Column, prefix: str = "P") -> Column:
    """Sorted whole numbers as runs, like ``P3-P5``; single ones alone."""
    empty = F.expr("cast(array() as array<struct<a:int,b:int>>)")

    def add(done: Column, n: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), n.alias("b"))))
        return F.when((F.size(done) > 0) & (last["b"] + 1 == n), grown).otherwise(F.concat(done, F.array(F.struct(n.alias("a"), n.alias("b")))))

    show = lambda r: F.when(r["a"] == r["b"], F.concat(F.lit(prefix), r["a"].cast("string"))).otherwise(F.concat(F.lit(prefix), r["a"].cast("string"), F.lit(f"-{prefix}"), r["b"].cast("string")))
    return F.transform(F.aggregate(F.transform(sorted_numbers, lambda n: n.cast("int")), empty, add), show)


def deltas(sorted_ids: Column) -> Column:
    """Each id less the one before it; the first as it is."""
    return F.transform(sorted_ids, lambda x, i: x - F.when(i > 0, F.get(sorted_ids, i - 1)).otherwise(F.lit(0)))


def undeltas(steps: Column) -> Column:
    """The ids that ``deltas`` were taken of."""
    return F.aggregate(steps, F.array().cast("array<bigint>"), lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x)))


def gap_accepted(ordered: Column, gap: int = 6) -> Column:
    """Of numbers in reading order those accepted one after another: greater than the last accepted by ``gap`` at most."""
    return F.aggregate(F.transform(ordered, lambda n: n.cast("int")), F.array().cast("array<int>"), lambda done, n: let(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)), lambda last: F.when((n > last) & (n <= last + gap), F.concat(done, F.array(n))).otherwise(done)))
