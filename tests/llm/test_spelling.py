import random
import re
import zlib
from collections import Counter

import pytest

from chainsift.llm import spelling as S


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_words(rows, damage):
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else (a[k + 1:] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1:])


def brute_variants(n):
    out, form = {}, {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = (form[w], len(near), n[form[w]] if form[w] else None)
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out[w] = (out[w][0], r, n[w], *out[w][1:])
    return out


def collected(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def some_words(seed, letters="abeilnst", many=250):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(many)]
    for w in list(base):
        k = rng.randrange(len(w))
        base.append([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]][rng.randrange(3)])
    return {w: 5 * rng.choice([1, 2, 5, 6, 30, 151]) + rng.randint(0, 4) for w in base if len(w) >= 6}


@pytest.mark.parametrize("crowd", [S.CLASS, 1])
def test_variants_equal_brute_force(spark, monkeypatch, crowd):
    """Also with every shared reduced word counted as crowded: the finer alphabet finds the same pairs."""
    monkeypatch.setattr(S, "CLASS", crowd)
    words = some_words(3) | {"élèvesé": 40, "élèves": 9, "elèves": 300, "÷×ÿÿÀÀ": 6, "÷×ÿÿÀ": 5, "aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200}
    df = spark.createDataFrame([(w, n, "clash") for w, n in words.items()], "word string, n long, key string")
    assert collected(S.variants(df)) == brute_variants(words)


def test_one_crowded_reduced_word(spark):
    """Several hundred words of four letters that reduce to the same symbol."""
    words = some_words(5, letters="aiqy", many=300)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert S._keyed(df, S.SYMBOLS).groupBy("key").count().where(f"count > {S.CLASS}").count() > 0
    assert collected(S.variants(df)) == brute_variants(words)


def test_ties_and_chains(spark):
    words = {"abcdefgh": 5, "abcdefg": 25, "abcdef": 125, "abcdez": 125, "abcdeff": 700, "solitary": 9}
    got = collected(S.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_variants(words)
    assert got["abcdefgh"][:2] == ("abcdefg", "abcdeff") and got["solitary"] == (None, "solitary", 9, 0, None)


def test_vocabulary_of_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "COUNTED", 50)
    monkeypatch.setattr(S, "RUNS", 7)
    rng = random.Random(2)
    words = ["Zauberer", "ÉLÈVEzza", "letters", "LETTERS", "kurz", "straßen", "naïveté", "x" * 3000, "a_b", "d'accord", "İstanbul", "été́tudes"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(40)]
    rows += [(1, None), (2, ""), (None, "letters straßen Zauberer " * 9), (7, rows[0][1]), (7, rows[0][1]), (8, "1234 --- \n\t"), (9, "letters " * 60_000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, word string")
    for damage in (None, 5):
        got = S.vocabulary(df, damage).collect()
        assert {r.word: r.n for r in got} == brute_words(rows, damage) and len(got) == len({r.word for r in got})


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    words = S.vocabulary(docs, 199)
    assert words.count() == 0 and S.variants(words).count() == 0
    assert S.variants(spark.createDataFrame([("lonely", 5)], "word string, n long")).collect()[0][:3] == ("lonely", None, "lonely")
