"""Store reads: block-range pages, seek pages and height."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Page order: block ascending, then the lineage key so ties are stable across pages.
PAGE_ORDER = ["block", "event", "file", "offset", "event_pos", "user_pos"]


def validate_page_args(start_block: int, end_block: int, page: int, size: int) -> None:
    """Page >= 1, size >= 1, 0 <= start <= end."""
    if page < 1:
        raise ValueError(f"page numbers start at 1, got {page}")
    if size < 1:
        raise ValueError(f"a page holds at least one event, got size {size}")
    if start_block < 0 or end_block < 0:
        raise ValueError("block numbers cannot be negative")
    if start_block > end_block:
        raise ValueError(f"empty block range: {start_block} is after {end_block}")


def events_by_block(events: DataFrame, start_block: int, end_block: int, page: int, size: int) -> DataFrame:
    """L2: page ``page`` (1-based) of events with start <= block <= end, in PAGE_ORDER.

    Plans as one TakeOrderedAndProject(limit, offset); the block predicate
    reaches the Parquet scan. For deep pages prefer ``events_after``.
    """
    validate_page_args(start_block, end_block, page, size)
    r = events.where(F.col("block").between(start_block, end_block)).orderBy(*PAGE_ORDER)
    return r.offset((page - 1) * size).limit(size)


def _after(cursor: dict) -> F.Column:
    """Strictly-after predicate on the composite key PAGE_ORDER."""
    cond = None
    for i in reversed(range(len(PAGE_ORDER))):
        k = PAGE_ORDER[i]
        term = F.col(k) > F.lit(cursor[k])
        if cond is not None:
            term = term | ((F.col(k) == F.lit(cursor[k])) & cond)
        cond = term
    return cond


def events_after(events: DataFrame, start_block: int, end_block: int, cursor: dict | None, size: int) -> DataFrame:
    """L3: keyset page: the next ``size`` events after ``cursor`` (a row's PAGE_ORDER values)."""
    validate_page_args(start_block, end_block, 1, size)
    r = events.where(F.col("block").between(start_block, end_block))
    if cursor is not None:
        r = r.where(F.col("block") >= F.lit(cursor["block"])).where(_after(cursor))
    return r.orderBy(*PAGE_ORDER).limit(size)


def latest_height(decoded_fill_lines: DataFrame) -> DataFrame:
    """A2: block of the last valid fill line in (hour, offset) order, 0 when there is none.

    Input: decode_fill_lines output with an ``hour_ts`` column. One global
    ``max_by`` = partial aggregates per task + one tiny final merge.
    """
    from decimal import Decimal

    ok = decoded_fill_lines.where(F.col("reason").isNull())
    # File order as one fixed-width key (hour in microseconds * 10^19 + byte offset): hash aggregate.
    order = F.unix_micros(F.col("hour_ts")).cast("decimal(38,0)") * F.lit(Decimal(10**19)) + F.col("offset").cast(
        "decimal(38,0)"
    )
    return ok.agg(F.coalesce(F.max_by("block", order.cast("decimal(38,0)")), F.lit(0).cast("bigint")).alias("height"))


def max_height(decoded_fill_lines: DataFrame) -> DataFrame:
    ok = decoded_fill_lines.where(F.col("reason").isNull())
    return ok.agg(F.coalesce(F.max("block"), F.lit(0).cast("bigint")).alias("height"))


def as_json(events: DataFrame) -> DataFrame:
    """One JSON object per event ``{"user","event","block","data"}``; VARIANT keys come out sorted."""
    return events.select(F.to_json(F.struct("user", "event", "block", "data")).alias("json"))


def page_json(page: DataFrame) -> DataFrame:
    """K7: one row holding the page as a JSON array in page order, ``[]`` when empty.

    Only for a page (its size is the page-size argument): the rows are
    gathered into one value, ordered by the page key, each encoded as
    ``{"user","event","block","data"}``.
    """
    item = F.struct(*[F.col(c) for c in PAGE_ORDER], F.to_json(F.struct("user", "event", "block", "data")).alias("_j"))
    ordered = F.sort_array(F.collect_list(item))
    text = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["_j"]), ","), F.lit("]"))
    return page.agg(F.coalesce(text, F.lit("[]")).alias("json"))
