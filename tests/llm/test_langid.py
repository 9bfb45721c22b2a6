import math

import pandas as pd
from pairwright.llm import langid
from pyspark.sql import functions as F


def test_kneser_ney_sums_to_one():
    text = "abracadabra abraca dabra cadabra barbara"
    pad = "\x01" * 3 + text + " "
    counts = pd.Series([pad[i : i + 4] for i in range(len(pad) - 3)]).value_counts()
    t = langid.kneser_ney(counts.sort_index())
    letters = sorted(set(text)) + ["z"]
    rows = langid.gram_scores([t], __import__("numpy").array([[ord(c) for c in "abr" + x] for x in letters]))
    assert abs(sum(math.exp(x) for x in rows[:, 0]) - 1) < 0.02
    assert rows[letters.index("a"), 0] > rows[letters.index("z"), 0]


def test_predictions(docs):
    said = {"en": "the cat and the dog went over the hill with their friends ", "de": "der hund und die katze gehen über den hügel mit freunden ", "fr": "le chien et le chat vont sur la colline avec des amis "}
    rows = [(k, (said[l].split()[k % 5] + " " + said[l]) * (1 + k % 3), l, "s") for k, l in enumerate(list(said) * 20)]
    extra = [(1000, None, None, "s"), (1001, "", None, "s"), (1002, "12 34 !!", "en", "s"), (1003, "THE DOG and the hill", None, "s"), (1004, said["de"] * 50_000, None, "s"), (1003, "THE DOG and the hill", None, "s"), (1005, "qzxw jvkq", None, "s")]
    table = docs([*rows, *extra])
    model = langid.fit(table.where("doc_id % 4 < 2"), table.where("doc_id % 4 = 3"))
    out = langid.identify(table.withColumns({"lang_pred": F.lit("clash"), "id": F.lit(0)}), model)
    got = {r["id"]: r for r in out.collect()}
    assert out.count() == len(rows) + len(extra)
    assert all(got[k]["lang_pred"] == l for k, _, l, _ in rows)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "en", "de"]
    assert got[1000]["rejected"] and got[1005]["rejected"] and not got[0]["rejected"]


def test_without_labels(docs):
    table = docs([(1, "some text", None, None), (2, None, None, None)])
    assert langid.fit(table, table) is None
    assert {r["lang_pred"] for r in langid.identify(table, None).collect()} == {"und"}
    assert langid.identify(docs([]).limit(0), None).count() == 0


def test_pieces_of_a_long_text(docs, monkeypatch):
    rows = [(1, "the quick brown fox " * 30, "en", "s"), (2, "der schnelle braune fuchs " * 30, "de", "s"), (3, "?" * 40 + "a" + " .!" * 30 + "b ß", "de", "s"), (4, "!" * 25, "en", "s"), (5, "𐐀𐐁 x 😀😀 y", "en", "s")]
    table = docs(rows)
    count = lambda: sorted(map(tuple, langid.gram_counts(table).collect()))
    model, grams = langid.fit(table, table), count()
    score = lambda: {r["id"]: (round(r["cross_entropy"], 9), r["n_letters"]) for r in langid.cross_entropies(table, model).collect()}
    whole = score()
    for size in (1, 2, 4, 7, 25):
        monkeypatch.setattr(langid, "PIECE", size)
        assert count() == grams and score() == whole, size


def test_characters_that_are_no_letters(docs):
    table = docs([(1, "the cat and the dog", "en", "s"), (2, "😀😀 🎉", None, "s"), (3, "𝄞 12", None, "s"), (4, "𐐀", None, "s")])
    got = {r["id"]: r["lang_pred"] for r in langid.identify(table, langid.fit(table, table)).collect()}
    assert got == {1: "en", 2: "und", 3: "und", 4: "en"}


def test_ties_between_languages(docs):
    same = "one and the same text of all"
    table = docs([(k, same, l, "s") for k, l in enumerate(("zz", "aa", "mm"))])
    assert {r["lang_pred"] for r in langid.identify(table, langid.fit(table, table)).collect()} == {"aa"}


def plain_kneser_ney(texts, order=langid.ORDER):
    """Interpolated Kneser-Ney after its published definition, in dictionaries; gives log p(last | before) for any gram."""
    counts = [{} for _ in range(order + 1)]
    for t in texts:
        clean = "\x01" * (order - 1) + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        for k in range(len(clean) - order + 1):
            g = clean[k : k + order]
            counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    vocabulary = max(2, len(counts[1]) + 1)

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / vocabulary
        level = counts[n]
        once, twice = (sum(v == k for v in level.values()) for k in (1, 2))
        d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05
        after = [v for g, v in level.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        return max(level.get(gram, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * p(gram[1:])

    return p


def test_against_plain_kneser_ney(docs):
    rng = __import__("random").Random(8)
    make = lambda a: " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 5))) for _ in range(25))
    known = [make("abcdeé") for _ in range(4)]
    asked = [make("abcdeé") for _ in range(3)] + [make("abxyz")]
    table = docs([*((k, t, "l", "s") for k, t in enumerate(known)), *((10 + k, t, None, "s") for k, t in enumerate(asked))])
    model, p = langid.fit(table, table), plain_kneser_ney(known)
    got = {r["id"]: r["cross_entropy"] for r in langid.cross_entropies(table, model).collect()}
    for k, t in [*enumerate(known), *enumerate(asked, 10)]:
        clean = "\x01" * 3 + " ".join(t.split()) + " "
        want = -sum(math.log(p(clean[i : i + 4])) for i in range(len(clean) - 3)) / (len(clean) - 3)
        assert abs(got[k] - want) < 1e-4, k


def test_joined_tables_hold_every_gram_and_language(docs):
    rng = __import__("random").Random(4)
    letters = {f"l{k:02}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyzäöüéß𐐨", 9)) for k in range(30)}
    rows = [(k * 30 + n, " ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(12)), name, "s") for n, (name, a) in enumerate(letters.items()) for k in range(4)]
    extra = [(1000, None, None, "s"), (1001, "", None, "s"), (1002, "12 34 !!", None, "s"), (1003, rows[5][1] * 40, None, "s"), (1003, rows[5][1] * 40, None, "s"), (None, rows[9][1], None, "s"), (1004, "ЖЩЪ", None, "s")]
    table = docs([*rows, *extra])
    learned, other = table.where("doc_id % 4 < 3"), table.where("doc_id % 4 = 3")
    sent, joined = langid.fit(learned, other), langid.fit(learned, other, max_grams=500)
    assert isinstance(joined.tables, langid.JoinedTables) and joined.languages == sent.languages == sorted(letters)
    a, b = (sorted(map(tuple, langid.cross_entropies(table, m).collect()), key=lambda r: (r[0] is None, r)) for m in (sent, joined))
    assert len(a) == len(b) == len(rows) + len(extra)
    for x, y in zip(a, b, strict=True):
        assert (x[0], x[1], x[4]) == (y[0], y[1], y[4]) and abs(x[2] - y[2]) < 1e-4 and abs(x[3] - y[3]) < 1e-4
    got = {r["id"]: (r["lang_pred"], r["rejected"]) for r in langid.identify(table, joined).collect()}
    assert got == {r["id"]: (r["lang_pred"], r["rejected"]) for r in langid.identify(table, sent).collect()}
