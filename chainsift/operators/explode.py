"""Blocks -> one row per user event.

Fills: each element must be an array of length >= 2 holding a string user and
an object payload; other elements are skipped, the line stays. Misc: each
event's ``inner.LedgerUpdate.users`` array gives one row per string user,
repeats and order kept; the payload is ``inner`` with the event's ``hash`` and
``time`` written over same-named keys.

Membership is applied between exploding and building the misc payload so the
payload work runs only on kept rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chainsift.functions.jsonv import as_object_map, is_object, is_string
from chainsift.schemas import EVENT_COLUMNS, EVENT_FILL, EVENT_MISC


def explode_fills(blocks: DataFrame) -> DataFrame:
    """(file, offset, block, events) -> canonical fill events.

    A negative block decodes but cannot be stored; those events are left out
    (the line still counts for height).
    """
    x = blocks.where(F.col("block") >= 0).select(
        "file", "offset", "block", F.posexplode("events").alias("event_pos", "e")
    )
    e = F.col("e")  # ARRAY<VARIANT>, or NULL for a null element
    first = F.try_element_at(e, F.lit(1))
    second = F.try_element_at(e, F.lit(2))
    ok = is_string(first) & is_object(second)
    return x.where(ok).select(
        F.try_variant_get(first, "$", "string").alias("user"),
        F.lit(EVENT_FILL).alias("event"),
        "block",
        second.alias("data"),
        "file",
        "offset",
        F.col("event_pos").cast("int").alias("event_pos"),
        F.lit(0).alias("user_pos"),
    )


def explode_misc_users(blocks: DataFrame) -> DataFrame:
    """(file, offset, block, events) -> one row per string user of a LedgerUpdate, payload not yet built.

    Columns: user, block, file, offset, event_pos, user_pos, e (the misc event struct).
    """
    x = blocks.select("file", "offset", "block", F.posexplode("events").alias("event_pos", "e"))
    inner = F.col("e")["inner"]
    ledger = F.variant_get(inner, "$.LedgerUpdate", "variant")
    users = F.try_variant_get(inner, "$.LedgerUpdate.users", "array<variant>")
    y = x.where(is_object(ledger) & users.isNotNull()).select(
        "file", "offset", "block", "event_pos", "e", F.posexplode(users).alias("user_pos", "u")
    )
    return y.where(is_string("u")).select(
        F.try_variant_get("u", "$", "string").alias("user"),
        "block", "file", "offset",
        F.col("event_pos").cast("int").alias("event_pos"),
        F.col("user_pos").cast("int").alias("user_pos"),
        "e",
    )


def misc_payload(rows: DataFrame) -> DataFrame:
    """Build the stored payload of exploded misc rows and project to canonical events."""
    e = F.col("e")  # STRUCT<time, hash, inner: VARIANT>
    h = F.coalesce(F.try_variant_get(e["hash"], "$", "string"), F.lit(""))
    t = F.coalesce(F.try_variant_get(e["time"], "$", "string"), F.lit(""))
    inner = as_object_map(e["inner"])
    data = F.to_variant_object(
        F.map_concat(
            F.map_filter(inner, lambda k, v: ~k.isin("hash", "time")),
            F.create_map(F.lit("hash"), h.cast("variant"), F.lit("time"), t.cast("variant")),
        )
    )
    return rows.select(
        "user", F.lit(EVENT_MISC).alias("event"), "block", data.alias("data"), "file", "offset", "event_pos", "user_pos"
    )


def explode_misc(blocks: DataFrame) -> DataFrame:
    return misc_payload(explode_misc_users(blocks))


def union_events(fills: DataFrame, misc: DataFrame) -> DataFrame:
    """One stream of canonical events."""
    return fills.select(*EVENT_COLUMNS).unionByName(misc.select(*EVENT_COLUMNS))
