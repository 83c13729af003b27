"""Repair of conversations by a generalised LR parse of their role sequence.

The role grammar's LR automaton is built from its productions. A parse keeps
one graph-structured stack: tops share what lies below them, each reads a turn
by keep, rerole or delete, may shift an inserted turn, and equal tops merge to
the one of least (cost, audit). In this grammar stacks with equal tops accept
the same continuations, so merging loses no cheapest repair; at equal cost no
audit is the beginning of another, so the least one stays least whatever
follows.

A conversation is cut into blocks of at most BLOCK turns. A block is parsed
from every top that it may start with, by itself and in parallel; the blocks'
(top, top, cost, audit) entries are then chained per conversation. Only these
entries, the audit (a letter a turn) and the running hash of a conversation
pass through one task; its turns never lie in memory together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainsift.llm.common import BROADCAST_IDS, stored

#: Productions of the role grammar over role initials; the first left side is the whole conversation.
GRAMMAR = (("C", ()), ("C", ("T",)), ("C", ("s", "T")), ("T", ("u", "a")), ("T", ("T", "u", "a")))
#: Roles that a turn may be given or inserted with, by initial.
ROLES = {"u": "user", "a": "assistant"}
#: Initials that may follow each other.
FOLLOWS = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns and characters of a block.
BLOCK, BLOCK_CHARS = 1024, 4 << 20
SPACE = "\t\n\x0b\x0c\r "
ENDS = ".!?"
#: The start of a conversation, as the top that a block's parse began with.
START = -1

Stack = tuple  # (state, stack below or None)


class Automaton:
    """LR(0) automaton of GRAMMAR: shifts and gotos by state, complete productions by state."""

    def __init__(self, grammar=GRAMMAR):
        self.start = grammar[0][0]
        items = [frozenset(self._closure({("", (self.start,), 0)}, grammar))]
        self.go: list[dict[str, int]] = []
        for state in items:  # grows
            out: dict[str, set] = {}
            for left, right, dot in state:
                if dot < len(right):
                    out.setdefault(right[dot], set()).add((left, right, dot + 1))
            self.go.append({})
            for symbol, kernel in sorted(out.items()):
                to = frozenset(self._closure(kernel, grammar))
                if to not in items:
                    items.append(to)
                self.go[-1][symbol] = items.index(to)
        self.complete = [sorted((left, len(right)) for left, right, dot in s if dot == len(right) and left not in ("", self.start)) for s in items]
        self.whole = [any(dot == len(right) and left == self.start for left, right, dot in s) for s in items]
        #: A stack for every top that can wait for a turn (repetition is left-recursive, so there are few stacks).
        self.stacks: dict[int, Stack] = {}
        new, seen = [(0, None)], set()
        while new:
            stack = new.pop()
            if stack not in seen:
                seen.add(stack)
                self.stacks.setdefault(stack[0], stack)
                new += [t for s in self.go[stack[0]] if s.islower() for t in self.shift(stack, s)]

    @staticmethod
    def _closure(kernel: set, grammar) -> set:
        out, new = set(kernel), list(kernel)
        while new:
            _, right, dot = new.pop()
            for left, body in grammar:
                if dot < len(right) and right[dot] == left and (left, body, 0) not in out:
                    out.add((left, body, 0))
                    new.append((left, body, 0))
        return out

    def shift(self, stack: Stack, symbol: str) -> list[Stack]:
        """Stacks after shifting ``symbol`` and all reductions, those that can wait for a turn."""
        to = self.go[stack[0]].get(symbol)
        if to is None:
            return []
        out, new = [], [(to, stack)]
        while new:
            now = new.pop()
            for left, n in self.complete[now[0]]:
                below = now
                for _ in range(n):
                    below = below[1]
                new.append((self.go[below[0]][left], below))
            if self.whole[now[0]] or any(s.islower() for s in self.go[now[0]]):
                out.append(now)
        return out


LR = Automaton()


class Parse:
    """Tops of the graph-structured stack: state -> (cost, audit, stack)."""

    def __init__(self, tops: dict[int, tuple[int, str, Stack]]):
        self.tops = tops

    @classmethod
    def begin(cls) -> Parse:
        p = cls({0: (0, "", LR.stacks[0])})
        p._insert()
        return p

    @staticmethod
    def _merge(tops: dict, cost: int, audit: str, stack: Stack) -> bool:
        now = tops.get(stack[0])
        if now is None or (cost, audit) < now[:2]:
            tops[stack[0]] = (cost, audit, stack)
            return True
        return False

    def _insert(self) -> None:
        new = list(self.tops.values())
        while new:
            cost, audit, stack = new.pop()
            for s in ROLES:
                for to in LR.shift(stack, s):
                    if self._merge(self.tops, cost + INSERT, audit + "I", to):
                        new.append(self.tops[to[0]])

    def drop(self, times: int = 1) -> None:
        """Deletes turns that have to go."""
        self.tops = {k: (cost + DELETE * times, audit + "D" * times, stack) for k, (cost, audit, stack) in self.tops.items()}
        self._insert()

    def read(self, initial: str, truncated: bool) -> None:
        tops: dict = {}
        more = TRUNCATED if truncated else 0
        for cost, audit, stack in self.tops.values():
            self._merge(tops, cost + DELETE, audit + "D", stack)
            for to in LR.shift(stack, initial) if initial.islower() else ():
                self._merge(tops, cost + more, audit + "K", to)
            for s in ROLES:
                for to in LR.shift(stack, s):
                    self._merge(tops, cost + REROLE + more, audit + "R", to)
        self.tops = tops
        self._insert()


def walk(top: int, audit: str, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that ``audit`` leaves of ``turns`` (role, text), from a stack top on."""
    stack, turns = LR.stacks[top], iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit in "IR":
            role = next(name for s, name in ROLES.items() if LR.shift(stack, s))  # one of them only can follow
        stack = LR.shift(stack, role[:1])[0]
        yield edit, role, text


def ordered(turns: DataFrame) -> DataFrame:
    """Turns as the parse reads them: key, conv_id, turn, role, text, n (equal rows), again (role and text occur in an earlier turn).

    Null role and text are one space; a null conv_id is a conversation of its
    own; null turns come first. Ties of a turn are in the order of role and
    text, so equal rows stand side by side and are counted before they move.
    """
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    rows = turns.select(key.alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = stored(rows.groupBy("key", "conv_id", "turn", "role", "text").agg(F.count("*").alias("n")), "turns")
    named = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(7), "role", "text")})
    known = F.col("turn").isNotNull().cast("int")
    first = named.groupBy("key", "h1", "h2").agg(F.count("*").alias("m"), F.min(known).alias("known"), F.min("turn").alias("least"))
    first = stored(first.where("m > 1").drop("m"), "repeated")
    many = named.join(F.broadcast(first) if first.count() <= BROADCAST_IDS else first, ["key", "h1", "h2"], "left")
    again = F.when(F.col("known") == 0, F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    return many.select("key", "conv_id", "turn", "role", "text", "n", F.coalesce(again, F.lit(False)).alias("again"))


ENTRY = "array<struct<top:int,to:int,cost:long,audit:string>>"
BLOCKS = (
    "key string, conv_id long, part int, sub int, roles array<string>, texts array<string>, copies array<long>, first_role string, last_role string, "
    f"first_turn long, last_turn long, least_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long, entries {ENTRY}"
)


def _arrow(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


class Block:
    """Turns of one conversation that follow each other, parsed from every top that they may follow.

    The first block (``sub`` 0) of a conversation that a task meets starts
    it if that is ``known``; else it may also go on from an earlier task.
    """

    def __init__(self, key, conv_id, part: int, sub: int, known: bool):
        self.key, self.conv_id, self.part, self.sub = key, conv_id, part, sub
        self.roles, self.texts, self.copies, self.chars = [], [], [], 0
        self.turns, self.low = [], None
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        starts = {} if sub else {START: Parse.begin()}
        more = {} if known and not sub else {k: Parse({k: (0, "", s)}) for k, s in LR.stacks.items()}
        self.parses = starts | more

    def full(self) -> bool:
        return len(self.roles) >= BLOCK or self.chars >= BLOCK_CHARS

    def add(self, turn, role: str, text: str, n: int, again: bool) -> None:
        body = text.strip(SPACE)
        if self.roles:
            self.illegal += self.roles[-1][:1] + role[:1] not in FOLLOWS
        self.illegal += (n - 1) * (role[:1] * 2 not in FOLLOWS)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.n_turns += 1
            self.low = turn if self.low is None else self.low
        self.turns = [*self.turns[:1], turn]
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(n)
        self.chars += len(text) + 2 * n
        if not body:
            self.blank += n
            gone = n
        else:
            gone = n if again else n - 1
            self.duplicate += gone
            if not again:
                cut = body[-1] not in ENDS
                self.truncated += cut
                for p in self.parses.values():
                    p.read(role[:1], cut)
        if gone:
            for p in self.parses.values():
                p.drop(gone)

    def row(self) -> dict:
        entries = [{"top": k, "to": to, "cost": c, "audit": a} for k, p in self.parses.items() for to, (c, a, _) in p.tops.items()]
        return {
            "key": self.key, "conv_id": self.conv_id, "part": self.part, "sub": self.sub, "roles": self.roles, "texts": self.texts, "copies": self.copies,
            "first_role": self.roles[0], "last_role": self.roles[-1], "first_turn": self.turns[0], "last_turn": self.turns[-1], "least_turn": self.low, "n_turns": self.n_turns,
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "entries": entries,
        }


def blocks(turns: DataFrame) -> DataFrame:
    """The parsed blocks of all conversations (BLOCKS), in the order (part, sub) within each."""
    spark = turns.sparkSession
    parts, schema = int(spark.conf.get("spark.sql.shuffle.partitions")), _arrow(BLOCKS)

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, now, known, done = TaskContext.get().partitionId(), None, False, []
        for b in it:
            for r in zip(*(b.column(c).to_pylist() for c in ("key", "conv_id", "turn", "role", "text", "n", "again"))):
                if now is not None and (r[0] != now.key or now.full()):
                    done.append(now)
                    known = known or r[0] != now.key
                    now = Block(r[0], r[1], part, now.sub + 1 if r[0] == now.key else 0, known)
                elif now is None:
                    now = Block(r[0], r[1], part, 0, False)  # may go on from the task before
                now.add(*r[2:])
                if len(done) >= 256 or sum(x.chars for x in done[-8:]) >= BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist([x.row() for x in done], schema)
                    done = []
        if now is not None:
            done.append(now)
        if done:
            yield pa.RecordBatch.from_pylist([x.row() for x in done], schema)

    place = ["key", F.asc_nulls_first("turn"), "role", "text"]
    return stored(ordered(turns).repartitionByRange(parts, *place).sortWithinPartitions(*place).mapInArrow(run, BLOCKS), "blocks")


class Link:
    """The cheapest parse that ends at a top after a block: what it came from and the block's audit."""

    __slots__ = ("cost", "back", "top", "audit", "block")

    def __init__(self, cost, back, top, audit, block):
        self.cost, self.back, self.top, self.audit, self.block = cost, back, top, audit, block

    def before(self, other: Link) -> bool:
        """Whether (cost, whole audit) is smaller; the audits are read back to where the two parses part."""
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, left, right = self, other, [], []
        while a is not b:
            left.append(a.audit)
            right.append(b.audit)
            a, b = a.back, b.back
        return "".join(reversed(left)) < "".join(reversed(right))


PLANS = "key string, conv_id long, cost long, audit string, blank long, duplicate long, truncated long, illegal long, gaps long, part int, sub int, top int"


def plans(parsed: DataFrame) -> DataFrame:
    """The cheapest repair, a row for each block of a conversation (PLANS).

    ``audit`` holds the block's edits and ``top`` the stack top they start
    from; the other columns are counts of the whole conversation and stand on
    the row of its last block only.
    """
    schema = _arrow(PLANS)

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        key, first, last, tops, sums, out = None, None, None, {}, {}, []

        def ended():
            best = None
            for k, link in tops.items():
                if LR.whole[k] and (best is None or link.before(best)):
                    best = link
            low, high, distinct = sums.pop("low"), sums.pop("high"), sums.pop("distinct")
            total = {"cost": best.cost, "gaps": 0 if low is None else high - low + 1 - distinct, **sums}
            while best is not None:
                out.append({"key": key, "conv_id": first["conv_id"], "part": best.block[0], "sub": best.block[1], "audit": best.audit, "top": max(best.top, 0), **total})
                best, total = best.back, {}

        for b in it:
            for r in b.to_pylist():
                if r["key"] != key:
                    if key is not None:
                        ended()
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                    key, first, last, tops = r["key"], r, None, {}
                    sums = {c: 0 for c in ("blank", "duplicate", "truncated", "illegal", "distinct")} | {"low": None, "high": None}
                new: dict[int, Link] = {}
                for e in r["entries"]:
                    back = tops.get(e["top"])
                    if (last is None) != (e["top"] == START) or (last is not None and back is None):
                        continue
                    link = Link((back.cost if back else 0) + e["cost"], back, e["top"], e["audit"], (r["part"], r["sub"]))
                    if e["to"] not in new or link.before(new[e["to"]]):
                        new[e["to"]] = link
                tops = new
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    sums[c] += r[c]
                sums["distinct"] += r["n_turns"]
                if r["last_turn"] is not None:
                    sums["low"] = r["least_turn"] if sums["low"] is None else sums["low"]
                    sums["high"] = r["last_turn"]
                if last is not None:
                    sums["illegal"] += last["last_role"][:1] + r["first_role"][:1] not in FOLLOWS
                    sums["distinct"] -= r["first_turn"] is not None and r["first_turn"] == last["last_turn"]
                last = r
        if key is not None:
            ended()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    small = parsed.drop("roles", "texts", "copies")
    return stored(small.repartition("key").sortWithinPartitions("key", "part", "sub").mapInArrow(run, PLANS), "plans")


REPAIRED = "key string, conv_id long, part int, sub int, place int, edit string, role string, text string"


def repaired(parsed: DataFrame, plan: DataFrame) -> DataFrame:
    """The turns of the repaired conversations (REPAIRED), in the order (part, sub, place)."""
    schema = _arrow(REPAIRED)

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        for b in it:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                rows = (x for x, n in zip(zip(r["roles"], r["texts"]), r["copies"]) for x in [x] * n)
                out = [{c: r[c] for c in ("key", "conv_id", "part", "sub")} | {"place": p, "edit": e, "role": role, "text": text} for p, (e, role, text) in enumerate(walk(r["top"], r["audit"], rows))]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    pieces = plan.select("key", "part", "sub", "top", "audit")
    joined = parsed.select("key", "conv_id", "part", "sub", "roles", "texts", "copies").join(F.broadcast(pieces) if small_plan(plan) else pieces, ["key", "part", "sub"])
    return joined.mapInArrow(run, REPAIRED)


def small_plan(plan: DataFrame) -> bool:
    """Whether the audits may be sent to all tasks: at most 2**18 blocks and 32 MB."""
    n, size = plan.agg(F.count("*"), F.sum(F.length("audit"))).first()
    return n <= 1 << 18 and (size or 0) <= 32 << 20


def hashes(turns: DataFrame) -> DataFrame:
    """(key, repaired_sha256): hash of ``role:text`` of the repaired turns, newline-joined; one turn in memory at a time."""

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa

        key, state, names, sums = None, None, [], []
        for b in it:
            for k, role, text in zip(*(b.column(c) for c in ("key", "role", "text"))):
                k = k.as_py()
                if k != key:
                    if key is not None:
                        names.append(key)
                        sums.append(state.hexdigest())
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(role.as_py().encode() + b":")
                state.update(text.as_py().encode())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums)], names=["key", "repaired_sha256"])
                names, sums = [], []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "repaired_sha256"])

    rows = turns.select("key", "part", "sub", "place", "role", "text").repartition("key").sortWithinPartitions("key", "part", "sub", "place")
    return rows.mapInArrow(run, "key string, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repaired turns, reports): the cheapest repair of every conversation of ``turns`` (conv_id, turn, role, text).

    Reports hold a row per conversation: key, conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit. Other columns are ignored, repeated rows
    are turns of their own (duplicates), an empty table gives empty results.
    See ``ordered`` for nulls and ties.
    """
    parsed = blocks(turns)
    plan = plans(parsed)
    whole = plan.select("key", "part", "sub", "audit").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sub", "audit"))), lambda x: x.audit), "").alias("audit"))
    counts = plan.where("cost is not null").select("key", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return repaired(parsed, plan), counts.join(whole, "key")


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with faults by crc32 of ``conv_id:turn`` modulo 20 (a null counts as one space there and in role and text)."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.encode(F.concat_ws(":", *named), "UTF-8")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    rows = rows.withColumns({
        "text": F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")),
        "times": F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))),
    })
    return rows.withColumn("times", F.explode("times")).drop("times", "fault")
