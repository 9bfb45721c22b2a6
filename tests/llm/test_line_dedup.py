import random

import pytest
from pairwright.llm import linededup
from pyspark.sql import functions as F


def distance(a, b, most=5):
    """Edits between two texts; cells further than ``most`` from the diagonal cannot matter below that."""
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            ways = [row[j] + 1] if j in row else []
            if j:
                ways += [new[j - 1] + 1] if j - 1 in new else []
                ways += [row[j - 1] + (x != b[j - 1])] if j - 1 in row else []
            new[j] = min(ways)
        row = new
    return row.get(len(b), most + 1)


def brute(rows):
    docs = {}
    for i, t in rows:
        docs.setdefault(i, t)
    lines = [((i is not None, i or 0), n, x.strip(" \t\r")) for i, t in docs.items() if t is not None for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    texts = sorted({x[2] for x in lines})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for k, a in enumerate(texts):
        for b in texts[:k]:
            size = min(len(a), len(b))
            edits = 4 if size >= 1000 else 2 if size >= 30 else 1 if size >= 9 else 0
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                root[find(a)] = find(b)
    first, gone = {}, {}
    for key, n, t in sorted(lines):
        if find(t) in first:
            gone.setdefault(key[1] if key[0] else None, []).append(n)
        else:
            first[find(t)] = (key, n)
    return gone


@pytest.fixture(scope="module")
def rows(text):
    rng = random.Random(4)
    base = text(1, 14)
    wide = "é" + text(2, 12) + "漢字𝒳"
    near = [base[:k] + rng.choice("xyz") + base[k + rng.randint(0, 1) :] for k in (0, 20, 45, 70, len(base) - 1)]
    chain = [base[:30] + "q" * n + base[30:] for n in range(1, 6)]
    short = "a line of thirty-five characters xx"
    return [
        (1, base + "\nunique " + text(3, 12)), (2, "  " + base + "\t\nshort\nshort"), (3, near[0] + "\n" + near[1]), (4, "\n".join(near[2:])), (5, "\n".join(chain)), (6, wide), (7, wide.replace("漢", "X") + "\n" + wide[1:]),
        (8, short + "\n" + short), (9, short[:-1] + "y"), (16, "All rights reserved.\n\n \n?"), (17, "All rights reserved\nAll rights reserved.\n?\n"), (18, "x" * 29 + "\n" + "x" * 28 + "y\n" + "x" * 30 + "\n" + "x" * 28 + "zz"), (10, None), (11, ""), (12, text(5, 3000)), (13, text(5, 3000) + "!"), (None, text(6, 20)), (14, text(6, 20)), (15, text(7, 20)), (15, text(7, 20)),
    ]


def test_against_brute_force(docs, rows):
    out = linededup.dedup(docs(rows).withColumns({"lines": F.lit("clash"), "id": F.lit(1)}))
    assert out.count() == len(rows)
    want = brute(rows)
    assert want[9] == [0] and want[17] == [0, 1, 2] and want[18] == [1, 2, 3]
    for r in out.collect():
        gone = want.get(r["doc_id"], [])
        assert list(r["lines"]["removed"]) == gone, r["doc_id"]
        whole = dict(rows)[r["doc_id"]]
        assert r["text"] == (whole if not gone else "\n".join(x for n, x in enumerate(whole.split("\n")) if n not in gone))


def test_many_alike_in_one_key(docs, text):
    base = text(9, 16)
    rows = [(k, base[:40] + "".join(random.Random(k).choice("mnopq") for _ in range(len(base) - 40))) for k in range(60)] + [(100, base), (101, base + "z")]
    got = {r["doc"]: list(r["removed"]) for r in linededup.duplicates(docs(rows)).collect()}
    assert got == brute(rows)


def test_edits_by_length(docs, text):
    """Lengths on both sides of each class, edits of every kind, long lines, and a line whose shorter partner is in the class below."""
    rng = random.Random(11)
    rows, more = [], "Click here to read more"
    for k, size in enumerate([7, 8, 9, 10, 15, 28, 29, 30, 31, 32, 90, 998, 999, 1000, 1001, 1003, 1520]):
        base = (text(100 + k, 300) + " ")[:size].strip().ljust(size, "e")
        rows.append((10 * k, base))
        for n in range(1, 6):
            t = base
            for _ in range(n):
                at = rng.randrange(len(t))
                t = rng.choice([t[:at] + "Q" + t[at:], t[:at] + t[at + 1 :], t[:at] + "Z" + t[at + 1 :]])
            rows.append((10 * k + n, t))
    rows += [(900, more), (901, more + "!"), (902, more + "!?.")]
    got = {r["doc"]: list(r["removed"]) for r in linededup.duplicates(docs(rows)).collect()}
    assert got == brute(rows)
    assert got[901] == [0] and 164 in got and 7 not in got


def test_empty(docs):
    assert linededup.dedup(docs([]).limit(0)).count() == 0
    assert linededup.dedup(docs([(1, None)])).first()["lines"]["n_removed"] == 0


def _parity(docs, texts):
    lines = docs([(k, t) for k, t in enumerate(texts)]).select(F.col("doc_id").alias("id"), F.col("text").alias("t"), F.length("text").alias("size"))
    return {r["id"]: r["parity"] for r in linededup._parities(lines).collect()}


def _turned(a, b):
    bits = [(x ^ y) & (2**64 - 1) for x, y in zip(a, b, strict=True)]
    return bits[-1].bit_count(), sum(x.bit_count() for x in bits[:-1])


def test_an_edit_turns_few_bits(docs, text):
    rng = random.Random(11)
    base = text(12, 12) + "é漢𝒳"
    one = [base[:k] + new + base[k + gone :] for k in range(len(base) + 1) for new, gone in ((rng.choice("xyzé𝒳 "), 0), (rng.choice("xyz漢"), 1), ("", 1))]
    found = _parity(docs, [base, *one, base[:20] + base[40:]])
    assert all(a <= 2 and b <= 4 for a, b in (_turned(found[0], found[k]) for k in range(1, len(one) + 1)))
    assert found[0] != found[len(one) + 1]


def test_copies_beyond_the_edits_make_few_pairs(docs, text, monkeypatch):
    """Copies of one line with four letters put in, of which no two are linked: what is verified in the end must not be all their pairs."""
    rng = random.Random(13)
    base = text(14, 30)
    copies = [base[:k] + "".join(rng.choice("bcdfghjklmpqrsvwxz") for _ in range(4)) + base[k:] for k in rng.sample(range(len(base)), 80)]
    twins = [copies[3][:-9] + "Q" + copies[3][-8:], copies[70][:9] + "Q" + copies[70][10:]]
    seen, verified = [], linededup._verified
    monkeypatch.setattr(linededup, "_verified", lambda pairs, *rest: seen.append(pairs) or verified(pairs, *rest))
    rows = list(enumerate([*copies, *twins]))
    gone = {r["doc"]: list(r["removed"]) for r in linededup.duplicates(docs(rows)).collect()}
    assert gone == brute(rows) and {80, 81} <= set(gone)
    assert len(seen) == 2 and seen[1].count() <= 80 * 79 / 2 / 10
