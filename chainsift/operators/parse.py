"""Line decoding with the upstream validity rules.

A line is dropped whole when it is not one JSON object, when ``block_number``
is not an integer of the right range, a time is not a string, ``events`` is not
an array, or an element has the wrong kind. Absent or null fields keep zero
values (block 0, no events). Type tests read the VARIANT type, never a cast:
``try_variant_get('"5"', 'bigint')`` would accept the string.

Cost notes: every field is extracted once, in its own projection (Catalyst
does not merge projections that would repeat a non-trivial expression); the
fill element rule is one cast to ``array<array<variant>>`` (a non-array
element comes out NULL, so NULL elements are checked against the JSON nulls of
the line, and only on lines that have any); the reason text is worked out only
for lines that fail the combined test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chainsift.functions.jsonv import absent_null_or, is_object, is_string, is_vnull, vtype, with_strict_json


def _field(v: Column, name: str) -> Column:
    return F.variant_get(v, f"$.{name}", "variant")


def _fields(lines: DataFrame) -> DataFrame:
    """Blank lines out (P4); the strict parse and the envelope fields, each computed once."""
    parsed = with_strict_json(
        lines.where(F.trim(F.col("value")) != F.lit("")).select("file", "offset", "value"), "value", "_v"
    )
    v = F.col("_v")
    return parsed.select(
        "file", "offset", "value", "_v",
        is_object(v).alias("_obj"),
        _field(v, "block_number").alias("_bn"),
        _field(v, "local_time").alias("_lt"),
        _field(v, "block_time").alias("_bt"),
        _field(v, "events").alias("_ev"),
    )


def _decoded(e: DataFrame, block: Column, events: Column, reason: Column) -> DataFrame:
    """Emit the decode results through a generator.

    Filters on ``reason`` can then not be pushed below the parse: without this
    barrier Catalyst substitutes the parse into the filter condition once per
    reference and every line would be parsed dozens of times.
    """
    res = F.struct(block.alias("block"), events.alias("events"), reason.alias("reason"))
    return e.select("file", "offset", "value", F.inline(F.array(res)))


def _elements_kind_ok(arr: Column) -> Column:
    """All elements of ``_ev`` cast cleanly into ``arr``: every NULL element of arr was a JSON null."""
    nulls = F.size(arr) - F.size(F.array_compact(arr))
    json_nulls = F.size(F.filter(F.try_variant_get("_ev", "$", "array<variant>"), lambda x: is_vnull(x)))
    return arr.isNotNull() & F.when(nulls == 0, F.lit(True)).otherwise(nulls == json_nulls)


def _reason(block_ok: Column, events_ok: Column, elements_ok: Column) -> Column:
    v, ev = F.col("_v"), F.col("_ev")
    times_ok = absent_null_or("_lt", is_string("_lt")) & absent_null_or("_bt", is_string("_bt"))
    all_ok = v.isNotNull() & F.col("_obj") & block_ok & times_ok & elements_ok
    return (
        F.when(all_ok, F.lit(None).cast("string"))
        .when(v.isNull(), F.lit("not_json"))
        .when(~F.col("_obj"), F.lit("not_object"))
        .when(~block_ok, F.lit("bad_block_number"))
        .when(~times_ok, F.lit("bad_time"))
        .when(~absent_null_or(ev, events_ok), F.lit("bad_events"))
        .otherwise(F.lit("bad_event_element"))
    )


def decode_fill_lines(lines: DataFrame) -> DataFrame:
    """(file, offset, value) -> + block, events (ARRAY<ARRAY<VARIANT>>), reason (NULL when valid)."""
    f = _fields(lines)
    tuples = f.select("*", F.try_variant_get("_ev", "$", "array<array<variant>>").alias("_arr"))
    bn = F.col("_bn")
    block_ok = absent_null_or(bn, vtype(bn) == F.lit("BIGINT"))
    events_ok = F.try_variant_get("_ev", "$", "array<variant>").isNotNull()
    elements_ok = absent_null_or("_ev", _elements_kind_ok(F.col("_arr")))
    return _decoded(
        tuples,
        F.coalesce(F.try_variant_get("_bn", "$", "bigint"), F.lit(0)),
        F.col("_arr"),
        _reason(block_ok, events_ok, elements_ok),
    )


def decode_misc_lines(lines: DataFrame) -> DataFrame:
    """As decode_fill_lines; block must be a non-negative integer that fits BIGINT, events objects.

    ``events`` comes out as ARRAY<STRUCT<time, hash, inner: VARIANT>>; a
    non-object element comes out NULL and is caught by the JSON-null count.
    """
    f = _fields(lines)
    evs = f.select(
        "*", F.try_variant_get("_ev", "$", "array<struct<time:variant,hash:variant,inner:variant>>").alias("_arr")
    )
    bn = F.col("_bn")
    blk = F.try_variant_get(bn, "$", "bigint")
    block_ok = absent_null_or(bn, (vtype(bn) == F.lit("BIGINT")) & (blk >= 0))
    events_ok = F.try_variant_get("_ev", "$", "array<variant>").isNotNull()

    def elem_ok(x):
        t, h, i = x["time"], x["hash"], x["inner"]
        return x.isNull() | (
            absent_null_or(t, is_string(t)) & absent_null_or(h, is_string(h)) & absent_null_or(i, is_object(i))
        )

    elements_ok = absent_null_or(
        "_ev", _elements_kind_ok(F.col("_arr")) & F.coalesce(F.forall("_arr", elem_ok), F.lit(True))
    )
    return _decoded(evs, F.coalesce(blk, F.lit(0)), F.col("_arr"), _reason(block_ok, events_ok, elements_ok))


def parse_fills(lines: DataFrame) -> DataFrame:
    """Valid fill lines: (file, offset, block, events)."""
    return decode_fill_lines(lines).where(F.col("reason").isNull()).select("file", "offset", "block", "events")


def parse_misc(lines: DataFrame) -> DataFrame:
    return decode_misc_lines(lines).where(F.col("reason").isNull()).select("file", "offset", "block", "events")


def bad_lines(lines: DataFrame, kind: str = "fill") -> DataFrame:
    """Side output of rejected lines: (file, offset, value, reason). Blank lines are not bad."""
    d = decode_fill_lines(lines) if kind == "fill" else decode_misc_lines(lines)
    return d.where(F.col("reason").isNotNull()).select("file", "offset", "value", "reason")
