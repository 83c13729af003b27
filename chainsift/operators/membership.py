"""Whitelist operators.

The whitelist is a table ``(address, score)``. Membership is an exact
left-semi join. The member count is checked first: up to
``BROADCAST_MAX_MEMBERS`` the list is broadcast, so the events are never
shuffled (file-size statistics alone would miss a large table filtered down to
few members, and AQE can only switch after the events were shuffled). Above
that Spark plans a shuffle join and AQE splits hot-user partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chainsift.schemas import WHITELIST_PAGE

# Largest member list sent to every task as a broadcast (~150 MB as a hash relation).
BROADCAST_MAX_MEMBERS = 2_000_000


def whitelisted(
    events: DataFrame, whitelist: DataFrame, user_col: str = "user", broadcast_max_rows: int = BROADCAST_MAX_MEMBERS,
    size: int | None = None,
) -> DataFrame:
    """Events whose user is a whitelist member (exact, byte-wise). ``size``: the member count, if known already."""
    members = whitelist.select(F.col("address").alias("_member"))
    if broadcast_max_rows > 0 and (members.count() if size is None else size) <= broadcast_max_rows:
        members = F.broadcast(members)
    return events.join(members, F.col(user_col) == F.col("_member"), "left_semi")


def events_with_any_member(misc_rows: DataFrame) -> DataFrame:
    """J4 event level: misc events with at least one whitelisted user, with their count."""
    return misc_rows.groupBy("file", "offset", "block", "event_pos").agg(F.count(F.lit(1)).alias("watched_users"))


def whitelist_range(wl: DataFrame, lo: float | str = "-inf", hi: float | str = "+inf", lo_open: bool = False) -> DataFrame:
    """Members with lo < score <= hi (lo inclusive unless lo_open)."""
    lo_v, hi_v = float(lo), float(hi)  # accepts "-inf" / "+inf"
    s = F.col("score")
    cond = (s > F.lit(lo_v)) if lo_open else (s >= F.lit(lo_v))
    return wl.where(cond & (s <= F.lit(hi_v)))


def whitelist_page(wl: DataFrame, after: tuple | None = None, size: int = WHITELIST_PAGE) -> DataFrame:
    """L3/L4: next page in (score, address) order strictly after the composite cursor."""
    df = wl
    if after is not None:
        sc, ad = after
        df = df.where((F.col("score") > F.lit(float(sc))) | ((F.col("score") == F.lit(float(sc))) & (F.col("address") > F.lit(ad))))
    return df.orderBy("score", "address").limit(size)


def whitelist_delta(wl: DataFrame, cursor: float, until: float) -> tuple[DataFrame, float]:
    """T4: members with cursor < score <= until, and the next cursor.

    The cursor moves to the largest score loaded, or stays when nothing came.
    It is one scalar from a distributed max (partial aggregates per task).
    """
    d = whitelist_range(wl, cursor, until, lo_open=True)
    top = d.agg(F.max("score").alias("m")).first()["m"]
    return d, float(cursor) if top is None else float(top)


def whitelist_merge(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Set union; an address present in both keeps the delta's score."""
    tagged = old.select("address", "score", F.lit(0).alias("_v")).unionByName(
        delta.select("address", "score", F.lit(1).alias("_v"))
    )
    return tagged.groupBy("address").agg(F.max_by("score", "_v").alias("score"))


def member_scores(events: DataFrame, wl: DataFrame, user_col: str = "user") -> DataFrame:
    """J5 in bulk: score of each distinct member among the events' users."""
    users = events.select(F.col(user_col).alias("address")).distinct()
    return users.join(wl.select("address", "score"), "address", "inner")


def member_score(wl: DataFrame, address: str) -> DataFrame:
    """Score of one member (empty when absent)."""
    return wl.where(F.col("address") == F.lit(address)).select("score")
