"""Hour-file paths: ``<root>/<type>/hourly/<yyyymmdd>/<h>`` with ``h`` unpadded, UTC."""

from pyspark.sql import Column, functions as F

from chainsift.schemas import HOURLY_DIR

# Fixed value: shape of a block-log path relative to the data folder.
PATH_PATTERN = r"(?:^|/)([^/]+)/hourly/([0-9]{8})/([0-9]{1,2})$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hour_path(log_type, ts) -> Column:
    """Relative hour-file path of a timestamp, e.g. node_fills_by_block/hourly/20240101/7."""
    ts = _c(ts)
    lt = F.lit(log_type) if isinstance(log_type, str) else log_type
    return F.concat_ws("/", lt, F.lit(HOURLY_DIR), F.date_format(ts, "yyyyMMdd"), F.hour(ts).cast("string"))


def decode_path(path) -> Column:
    """Struct(type, date, hour, hour_ts) decoded from a path; NULL fields when it does not fit.

    Month 1-12, hour 0-23 and a real calendar day are required (a day that
    overflows, like Feb 31, is rejected instead of rolling over).
    """
    p = _c(path)
    typ = F.regexp_extract(p, PATH_PATTERN, 1)
    date = F.regexp_extract(p, PATH_PATTERN, 2)
    hour = F.regexp_extract(p, PATH_PATTERN, 3)
    ok = typ != F.lit("")
    hour_i = F.when(ok, hour.try_cast("int"))
    ts = F.try_make_timestamp(
        F.substring(date, 1, 4).try_cast("int"),
        F.substring(date, 5, 2).try_cast("int"),
        F.substring(date, 7, 2).try_cast("int"),
        hour_i,
        F.lit(0),
        F.lit(0),
    )
    valid = ok & hour_i.between(0, 23) & ts.isNotNull()
    return F.struct(
        F.when(valid, typ).alias("type"),
        F.when(valid, date).alias("date"),
        F.when(valid, hour_i).alias("hour"),
        F.when(valid, ts).alias("hour_ts"),
    )


def rel_path(path) -> Column:
    """Path relative to the data folder: '<type>/hourly/<date>/<h>'."""
    return F.regexp_extract(_c(path), r"([^/]+/hourly/[0-9]{8}/[0-9]{1,2})$", 1)


def iso_nanos(ts) -> Column:
    """ISO-8601 UTC text with 9 fractional digits and 'Z', like the log's block times."""
    return F.concat(F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))
