import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from chainsift.llm import turnrepair as R

SPACE = "\t\n\x0b\x0c\r "


def faults(rows):
    """Brute force: (role, text, fault) in order, with the counts of a conversation's rows (turn, role, text)."""
    rows = sorted(((t is not None, t or 0), " " if r is None else r, " " if x is None else x) for t, r, x in rows)
    seen, out, n = set(), [], dict(blank=0, duplicate=0, truncated=0, illegal=0)
    for k, (turn, role, text) in enumerate(rows):
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        n["illegal"] += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        out.append((role, text, fault))
    turns = [t for (known, t), _, _ in rows if known]
    n["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return out, n


def cheapest(rows):
    """Brute force over the minimal repairs: (cost, audit, turns), states of `(s?(ua)+)?` as output texts so far."""
    best = {0: (0, "", ())}

    def insert(best):
        while True:
            more = dict(best)
            for state, (c, a, o) in best.items():
                to, role = (3, "assistant") if state == 2 else (2, "user")
                new = (c + 2, a + "I", o + ((role, ""),))
                if to not in more or new < more[to]:
                    more[to] = new
            if more == best:
                return best
            best = more

    best = insert(best)
    for role, text, fault in rows:
        new = {}
        for state, (c, a, o) in best.items():
            options = [(state, c + 3, a + "D", o)]
            if fault not in ("blank", "duplicate"):
                c += fault == "truncated"
                allowed = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
                if role[:1] and role[:1] in allowed:
                    options.append(({"s": 1, "u": 2, "a": 3}[role[:1]], c, a + "K", o + ((role, text),)))
                give = "assistant" if state == 2 else "user"
                options.append((3 if state == 2 else 2, c + 2, a + "R", o + ((give, text),)))
            for to, *rest in options:
                if to not in new or tuple(rest) < new[to]:
                    new[to] = tuple(rest)
        best = insert(new)
    return min(best[k] for k in (0, 3) if k in best)


def answer(rows):
    seq, n = faults(rows)
    cost, audit, turns = cheapest(seq)
    said = "\n".join(f"{r}:{t}" for r, t in turns)
    return n | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(said.encode()).hexdigest()}


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, part int")
    kept, reports = R.repair(df)
    got = {r.conv_id: r.asDict() for r in reports.join(R.hashes(kept), "key", "left").collect()}
    for g in got.values():
        g["repaired_sha256"] = g["repaired_sha256"] or hashlib.sha256(b"").hexdigest()
        del g["key"], g["conv_id"]
    return got


def by_conversation(rows):
    out = {}
    for c, *rest in rows:
        out.setdefault(c, []).append(tuple(rest))
    return out


def random_rows(seed, conversations=60, longest=9):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Tool", "unknown"]
    texts = ["Yes.", "No!", "cut", " ", "", None, "Why?  \n", "Yes.", " ", "a" * 50]
    rows = []
    for c in range(conversations):
        for k in range(rng.randint(1, longest)):
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                rows.append((c if c else None, rng.choice([k, k, 2 * k, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."))
    return rows


@pytest.mark.parametrize("block", [R.BLOCK, 2])
def test_equals_brute_force(spark, monkeypatch, block):
    """Nulls everywhere, ties, repeated rows, unknown roles; whole conversations and blocks of two turns."""
    monkeypatch.setattr(R, "BLOCK", block)
    rows = random_rows(1) + random_rows(2, 3, 60)
    want = {c: answer(r) for c, r in by_conversation(rows).items()}
    assert run(spark, rows) == want


def test_the_automaton_finds_the_cheapest_of_all_edit_sequences():
    """Every edit sequence is tried, without dynamic programming."""
    good = re.compile("(s?(ua)+)?")

    def least(rows):
        best = None
        for n_insert in range(4):
            for letters in set(itertools.permutations("I" * n_insert + "x" * len(rows))) if len(rows) + n_insert < 7 else ():
                slots = [k for k, x in enumerate(letters) if x == "x"]
                for edits in itertools.product("KRD", repeat=len(rows)):
                    audit = list(letters)
                    for k, e in zip(slots, edits):
                        audit[k] = e
                    for roles in itertools.product(*[(("u", "a") if e in "RI" else ("",)) for e in audit]):
                        it, cost, said, ok = iter(rows), 0, "", True
                        for e, r in zip(audit, roles):
                            if e == "I":
                                cost, said = cost + 2, said + r
                                continue
                            role, fault = next(it)
                            if e == "D":
                                cost += 3
                                continue
                            ok &= fault is None or fault == "truncated"
                            cost += (fault == "truncated") + (2 if e == "R" else 0)
                            said += r or role
                        if ok and good.fullmatch(said) and (best is None or (cost, "".join(audit)) < best):
                            best = (cost, "".join(audit))
        return best

    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.choice([None, None, "truncated", "blank"])) for _ in range(rng.randint(0, 3))]
        p = R.Parse.begin()
        for role, fault in rows:
            if fault == "blank":
                p.drop()
            else:
                p.read(role, fault == "truncated")
        assert min(t[:2] for k, t in p.tops.items() if R.LR.whole[k]) == least(rows), rows


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    """Cut over tasks and blocks, with a row repeated many times: the same repair as in one piece."""
    monkeypatch.setattr(R, "BLOCK", 16)
    rng = random.Random(9)
    rows = [(5, k, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][k % 2], f"say {k}" + rng.choice([".", ""])) for k in range(3000)]
    rows += [(5, 1500, "user", "again and again.")] * 2000 + [(k, 0, "user", "Hi.") for k in range(100, 140)]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = run(spark, rows)
    assert got == {c: answer(r) for c, r in by_conversation(rows).items()}
    parsed = R.blocks(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert parsed.where("conv_id = 5").select("part").distinct().count() > 1


def test_damage_and_empty_tables(spark):
    rows = random_rows(6, 40)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            x = ""
        if fault == 2:
            x = re.sub("[.!?]", "", x)
        if fault == 4:
            r = "user"
        want += [(c, t, r, x)] * (2 if fault == 3 else 1)
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in R.damage(df).collect()), key=order) == sorted(want, key=order)
    kept, reports = R.repair(df.where(F.lit(False)))
    assert kept.count() == 0 and reports.count() == 0


def test_long_texts(spark):
    rows = [(1, 0, "user", "a" * 3_000_000 + "."), (1, 1, "assistant", "b" * 3_000_000), (1, 2, "assistant", "c.")]
    assert run(spark, rows) == {1: answer([r[1:] for r in rows])}
