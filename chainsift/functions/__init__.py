"""Column-level helpers (all built-in Spark expressions, no UDFs)."""

from chainsift.functions.address import address
from chainsift.functions.jsonv import (
    strict_parse_json,
    vtype,
    is_vnull,
    as_array,
    as_object_map,
    is_string,
    is_object,
    is_array,
)
from chainsift.functions.paths import hour_path, decode_path, rel_path, iso_nanos

__all__ = [
    "address", "strict_parse_json", "vtype", "is_vnull", "as_array", "as_object_map",
    "is_string", "is_object", "is_array", "hour_path", "decode_path", "rel_path", "iso_nanos",
]
