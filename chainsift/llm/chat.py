"""Chat formatting over reply trees.

Turns point to the turn they answer; root-to-leaf paths come from iterative
self-joins (pointer doubling, log2(depth) rounds), branches are ranked by
score and each chosen path is one formatted conversation, kept as one row per
turn in order so that no conversation has to fit into one value.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainsift.llm.common import stored

#: A turn reads <s>[INST]role[/INST]text</s>; these four strings never occur inside an escaped role or text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
#: Roles whose text a model is trained on.
LOSS_ROLES = ("assistant",)
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(col):
    """Backslashes are doubled, and one is put after the first character of every control string."""
    col = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    col = F.regexp_replace(col, r"<(/?s>)", r"<\\$1")
    return F.regexp_replace(col, r"\[(/?INST\])", r"[\\$1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation: the inverse of the template."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def nodes(turns: DataFrame) -> DataFrame:
    """Turns as tree nodes: key, pos (order in the conversation), up (pos answered, null at a root).

    ``parent`` holds the turn number answered; without that column each turn
    answers the one before it. ``score`` counts 0 where null or missing. Null
    conv_id is a conversation of its own, null role and text are empty, null
    turns come first, ties are ordered by role and text, and repeated rows are
    turns of their own. A parent that is missing or not earlier makes a root.
    """
    has = set(turns.columns)
    n = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null")).alias("key"),
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        (F.col("parent") if "parent" in has else F.lit(None)).cast("long").alias("parent"),
        F.coalesce((F.col("score") if "score" in has else F.lit(0)).cast("double"), F.lit(0.0)).alias("score"),
    ).withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("turn", "role", "text")).cast("long"))
    if "parent" not in has:
        return n.withColumn("up", F.when(F.col("pos") > 1, F.col("pos") - 1))
    n = stored(n, "turns")
    at = n.where("turn is not null").groupBy("key", F.col("turn").alias("parent")).agg(F.min("pos").alias("up"))
    return n.join(at, ["key", "parent"], "left").withColumn("up", F.when(F.col("up") < F.col("pos"), F.col("up")))


def paths(turns: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` highest-scoring root-to-leaf paths of each conversation, a row per turn.

    Returns key, conv_id, branch (rank of the path, 1 first), pos, role, text.
    A path's score is the sum over its turns; ties go to the earlier leaf.
    """
    n = stored(nodes(turns), "nodes")
    step, levels = stored(n.select("key", "pos", "up", "score"), "jump"), []
    while step.where("up is not null").limit(1).count():
        levels.append(step)
        over = step.select("key", F.col("pos").alias("up"), F.col("up").alias("up2"), F.col("score").alias("more"))
        moved = step.where("up is not null").join(over, ["key", "up"]).select("key", "pos", F.col("up2").alias("up"), (F.col("score") + F.col("more")).alias("score"))
        step = stored(moved.union(step.where("up is null")), "jump")  # only turns that have not reached their root take part
    answered = n.select("key", F.col("up").alias("pos")).where("pos is not null").distinct()
    rank = Window.partitionBy("key").orderBy(F.desc("score"), "pos")
    leaf = step.join(answered, ["key", "pos"], "left_anti").withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= best)
    on = leaf.select("key", "branch", "pos")
    for level in reversed(levels):
        on = stored(on, "paths")
        on = on.union(on.join(level.where("up is not null"), ["key", "pos"]).select("key", "branch", F.col("up").alias("pos")))
    return on.join(n, ["key", "pos"]).select("key", "conv_id", "branch", "pos", "role", "text")


def format_paths(chosen: DataFrame) -> DataFrame:
    """Adds ``piece`` (the formatted turn) and its loss span ``loss_start``/``loss_end`` in code points (null outside the loss)."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit("<s>[INST]"), role, F.lit("[/INST]"))
    out = chosen.withColumns({"_head": head, "_body": text})
    trained = F.col("role").isin(*LOSS_ROLES)
    return out.select(
        "key", "conv_id", "branch", "pos",
        F.concat("_head", "_body", F.lit("</s>")).alias("piece"),
        F.when(trained, F.length("_head")).alias("loss_start"),
        F.when(trained, F.length("_head") + F.length("_body")).alias("loss_end"),
    )


def conversations(pieces: DataFrame) -> DataFrame:
    """One row per chosen path with the whole ``formatted`` text (a row must fit into memory; else read the pieces in order)."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x.piece), "")
    return pieces.groupBy("key", "conv_id", "branch").agg(joined.alias("formatted"))


DIGEST = "conv_id long, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(pieces: DataFrame) -> DataFrame:
    """Reads the formatted turns back, in order, holding one turn at a time; one DIGEST row per path."""

    def run(it: Iterator) -> Iterator:
        import pandas as pd

        key, state, out = None, None, []
        for pdf in it:
            for k, conv, branch, piece, a, b in zip(pdf.key, pdf.conv_id, pdf.branch, pdf.piece, pdf.loss_start, pdf.loss_end):
                if (k, branch) != key:
                    if state:
                        out.append(state)
                    key, state = (k, branch), [None if k == "null" else int(conv), branch, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(piece):
                    state[2] += 1
                    state[3].update(f"{role}\n{text}\n".encode())
                if b == b and b is not None:
                    text = unescape(piece[int(a): int(b)])
                    state[4] += len(text)
                    state[5].update(text.encode())
                state[6] += len(piece)
            if len(out) >= 10_000:
                yield frame(pd, out)
                out = []
        yield frame(pd, out + [state] if state else out)

    def frame(pd, rows):
        cols = [c.split()[0] for c in DIGEST.split(", ")]
        pdf = pd.DataFrame([[*r[:3], r[3].hexdigest(), r[4], r[5].hexdigest(), r[6]] for r in rows], columns=cols)
        return pdf.astype({"conv_id": "Int64"})

    dealt = pieces.repartition("key", "branch").sortWithinPartitions("key", "branch", "pos")
    return dealt.mapInPandas(run, DIGEST)
