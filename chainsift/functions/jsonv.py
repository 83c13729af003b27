"""Strict JSON decoding and type tests on VARIANT values.

The upstream decoder rejects a line with text after the JSON value, while
``try_parse_json`` accepts it. Wrapping the line as ``[<line>,"<sentinel>"]``
and requiring a two-element array ending in the sentinel restores the strict
rule with one parse.
"""

from pyspark.sql import Column, functions as F

# Fixed value: end-of-line marker used by the strict parse wrap.
SENTINEL = "~chainsift-eol~"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wrapped_parse(value) -> Column:
    """Step 1 of the strict parse: ``try_parse_json('[' || value || ',"<sentinel>"]')``."""
    return F.try_parse_json(F.concat(F.lit("["), _c(value), F.lit(f',"{SENTINEL}"]')))


def unwrap(w) -> Column:
    """Step 2: the value when the wrap is a two-element array ending in the sentinel, else NULL."""
    w = _c(w)
    ok = (F.try_variant_get(w, "$[1]", "string") == F.lit(SENTINEL)) & F.try_variant_get(w, "$[2]", "variant").isNull()
    return F.when(ok, F.variant_get(w, "$[0]", "variant"))


def strict_parse_json(value) -> Column:
    """VARIANT of a line holding exactly one JSON value, else NULL.

    As one expression the wrap is referenced three times; in DataFrames use
    ``with_strict_json`` so the parse runs once per row in any execution mode.
    """
    return unwrap(wrapped_parse(value))


def with_strict_json(df, value: str, out: str):
    """Add ``out`` = strict parse of ``value``, with the parse in its own projection."""
    return df.withColumn("_wrapped", wrapped_parse(value)).withColumn(out, unwrap("_wrapped")).drop("_wrapped")


def vtype(v) -> Column:
    """Type name of a VARIANT value ('STRING', 'BIGINT', 'VOID', 'OBJECT<..>', ...)."""
    return F.schema_of_variant(_c(v))


def is_vnull(v) -> Column:
    """True for a JSON null (not for an absent value)."""
    return F.is_variant_null(_c(v))


def as_array(v) -> Column:
    """ARRAY<VARIANT> if the value is a JSON array, else NULL."""
    return F.try_variant_get(_c(v), "$", "array<variant>")


def as_object_map(v) -> Column:
    """MAP<STRING,VARIANT> if the value is a JSON object, else NULL (reads only the top level)."""
    return F.try_variant_get(_c(v), "$", "map<string,variant>")


def is_string(v) -> Column:
    return F.coalesce(vtype(v) == F.lit("STRING"), F.lit(False))


def is_object(v) -> Column:
    """True for a JSON object; casts to a one-field struct so only the top level is read."""
    return F.try_variant_get(_c(v), "$", "struct<__probe:variant>").isNotNull()


def is_array(v) -> Column:
    return as_array(v).isNotNull()


def absent_null_or(v, test: Column) -> Column:
    """Upstream struct decoding: an absent or null field keeps its zero value."""
    v = _c(v)
    return v.isNull() | is_vnull(v) | test
