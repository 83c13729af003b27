import random
import re

import numpy as np
import pytest

from chainsift.llm import personal as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    """The fixed patterns as they are written, checks after them."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def card(rng):
    head = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(head + str(k) for k in range(10) if P.luhn(head + str(k)))


def value(rng, kind):
    if kind == 0:
        return f"{rng.choice(['ann', 'bob.k', 'x_y'])}.{rng.randrange(100)}@mail{rng.randrange(9)}.example.com"
    if kind == 1:
        return ".".join(str(rng.randrange(1, 255)) for _ in range(4))
    return card(rng) if kind == 2 else f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"


@pytest.fixture(scope="module")
def trained(spark):
    """Documents with single values, and the tagger trained on them."""
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("aeinorsté") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(k, f"{text(20)}. {value(rng, k % 4)} {text(15)}, {value(rng, rng.randrange(4))}. {text(5)}") for k in range(160)]
    rows += [(k, f"{text(10)} token = \"{rng.getrandbits(128):032x}\" {text(4)} {rng.randrange(10**5)}.") for k in range(160, 240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return rng, text, docs, P.fit(docs)


def test_patterns_equal_the_expressions():
    rng = random.Random(1)
    for alphabet in ("0123 -", "12.3", "+1 ()-.5", "a@.b-1+%", "4111 -+@.()a"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            assert P.pattern_spans(text) == sorted(brute(text)), text
    pile = "4111111111111111 +1 (555) 555-1234, 1.2.3.4.5.6.7.8 a@b.cc@d.ee 300.1.2.3 4111-1111-1111-1111 "
    assert P.pattern_spans(pile) == sorted(brute(pile))


def test_patterns_are_linear_on_long_runs():
    for text in ("1" * 2_000_000, "a" * 2_000_000, "1." * 1_000_000 + "x", "1 " * 1_000_000, "@" * 500_000, "+1" * 500_000, "9" * 5000 + ".1.1.1"):
        P.pattern_spans(text)


def test_gradient_matches_differences():
    t, rng = P.Tagger(), np.random.default_rng(0)
    for k in t.w:
        t.w[k] = t.w[k].astype(np.float64)
    x, tags = rng.integers(1, 150, (3, 10)), np.zeros((3, 10), int)
    tags[0, 2:5], tags[1, 0:3], tags[2, 7:] = [1, 2, 2], [5, 6, 6], [7, 8, 8]
    _, g = t.gradient(x, tags)
    for k, v in t.w.items():
        for _ in range(3):
            i = (int(x[0, 3]), 4) if k == "embed" else (0, 2 * int(rng.integers(4)) + 1) if k == "next" else tuple(int(rng.integers(s)) for s in v.shape)
            old = v[i]
            v[i] = old + 1e-3
            up = t.gradient(x, tags)[0]
            v[i] = old - 1e-3
            down = t.gradient(x, tags)[0]
            v[i] = old
            assert abs((up - down) / 2e-3 - g[k][i]) < 1e-3 * (1 + abs(g[k][i])), k


def test_held_out_values_side_by_side(trained):
    """New texts: the tagger finds what the patterns drop, and adds nothing to texts without values."""
    rng, text, _, tagger = trained
    texts, want = [], []
    for _ in range(100):
        head = text(rng.randint(0, 40)) + " "
        a, b = value(rng, 3), value(rng, 2)
        texts.append(f"{head}{a} {b} {text(10)}")
        want.append({(3, len(head), len(head) + len(a)), (2, len(head) + len(a) + 1, len(head) + len(a) + 1 + len(b))})
    got = [set(P.added_spans(t, P.pattern_spans(t), s)) for t, s in zip(texts, P.tagged_spans(texts, tagger))]
    assert all(not P.pattern_spans(t) for t in texts)
    assert sum(len(g & w) for g, w in zip(got, want)) >= 0.9 * 200 and not any(g - w for g, w in zip(got, want))
    clean = [f"{text(30)} {rng.randrange(10**6)} {rng.getrandbits(160):040x} {text(9)} {rng.randrange(3000)}-{rng.randrange(99)}." for _ in range(150)]
    added = [P.added_spans(t, P.pattern_spans(t), s) for t, s in zip(clean, P.tagged_spans(clean, tagger))]
    assert not any(added)


def test_windows_cover_and_reconcile():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice("a" * 60 + "1@") for _ in range(rng.randint(0, 700)))
        starts = list(P.windows(text))
        every = [a for a in range(0, max(len(text), 1), P.STEP) if P.ANCHOR.search(text[a: a + P.WINDOW])]
        assert starts == every
    spans = [(rng.randrange(2), a, a + rng.randint(1, 6), rng.random()) for a in range(9)]

    def most(left, end):
        return max([(0.0, ())] + [(s + more, ((k, a, z), *rest)) for k, a, z, s in left if a >= end for more, rest in [most(left, z)]])

    assert P.reconcile(spans) == list(most(spans, 0)[1])


def test_whole_table(spark, trained):
    """Base spans equal brute force in every row; nulls, empty, repeated, long texts, clashing columns."""
    rng, text, docs, tagger = trained
    long = (text(3000) + " ") * 60 + value(rng, 3) + " " + value(rng, 2)
    extra = [(900, None), (901, ""), (None, value(rng, 0)), (902, long), (903, "no value"), (903, "no value"), (904, value(rng, 2) + " " + value(rng, 1))]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + extra
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, personal string, n_added long")
    out = P.find(df, tagger)
    assert out.columns == ["doc_id", "text", "n_added", "personal"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        base = [(P.KINDS.index(s.kind), s.start, s.end) for s in r.personal if s.base]
        assert base == sorted(brute(r.text or ""))
        assert [(P.KINDS.index(s.kind), s.start) for s in r.personal] == sorted((P.KINDS.index(s.kind), s.start) for s in r.personal)
    of = {r.doc_id: [(s.kind, s.base) for s in r.personal] for r in got}
    assert of[902] == [("card", False), ("phone", False)] and of[900] == of[901] == of[903] == []


def test_no_values_and_empty_table(spark):
    none = spark.createDataFrame([(1, "words only"), (2, None)], "doc_id long, text string")
    assert P.fit(none) is None
    assert [r.personal for r in P.find(none, None).collect()] == [[], []]
    empty = none.limit(0)
    assert P.fit(empty) is None and P.find(empty, None).count() == 0


def test_sample_is_bounded_and_the_same_for_every_partitioning(spark, trained):
    docs = trained[2]
    one, many = (P.labelled(docs.repartition(k), 20) for k in (1, 7))
    assert one == many and max(sum(v.kind == k for v in one) for k in range(-1, 4)) == 20


def test_query_over_a_table(spark, tmp_path):
    """The registered query against the patterns as they are written."""
    import hashlib

    from chainsift.llm.queries import op13_personal_data

    rng = random.Random(4)
    rows = [(k, "words " * rng.randint(0, 9) + " ".join(value(rng, rng.randrange(4)) for _ in range(rng.randrange(3)))) for k in range(80)] + [(80, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op13_personal_data(spark, str(tmp_path)).collect()}
    assert len(got) == 81
    for doc, text in rows:
        spans, r = sorted(brute(text or "")), got[doc]
        said = [f"{P.KINDS[k]}:{a}:{z}" for k, a, z in spans]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",")) | {""} and len([s for s in r.spans.split(",") if s]) == len(said) + r.n_added
