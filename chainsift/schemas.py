"""Fixed names, constants and StructTypes shared by every module."""

from pyspark.sql import types as T

# Fixed values that must equal the upstream log layout and service behaviour.
FILL_TYPE = "node_fills_by_block"
MISC_TYPE = "misc_events_by_block"
LOG_TYPES = (FILL_TYPE, MISC_TYPE)
EVENT_FILL = "fill"
EVENT_MISC = "misc"
EVENT_TYPES = (EVENT_FILL, EVENT_MISC)
ACTIONS = ("subscribe", "unsubscribe")
HOURLY_DIR = "hourly"
WHITELIST_PAGE = 1000
RETENTION_DAYS = 7
BLOOM_CAPACITY = 100_000_000
BLOOM_ERROR = 0.01

# Raw line rows produced by the block-log source.
LINE_SCHEMA = T.StructType([
    T.StructField("file", T.StringType(), False),
    T.StructField("offset", T.LongType(), False),
    T.StructField("value", T.StringType(), False),
])

# Canonical event row (user, event, block, data) plus its lineage key
# (file, offset, event_pos, user_pos), which stands in for the surrogate id.
EVENT_COLUMNS = ["user", "event", "block", "data", "file", "offset", "event_pos", "user_pos"]
LINEAGE_KEY = ["file", "offset", "event_pos", "user_pos"]

# Event store table.
STORE_COLUMNS = EVENT_COLUMNS + ["created_at", "ingest_date"]

WHITELIST_SCHEMA = T.StructType([
    T.StructField("address", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False),
])

SUBSCRIPTION_LOG_SCHEMA = T.StructType([
    T.StructField("client_id", T.LongType(), False),
    T.StructField("action", T.StringType(), True),
    T.StructField("event", T.StringType(), True),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("seq", T.LongType(), False),
])

POSITION_SCHEMA = T.StructType([
    T.StructField("file", T.StringType(), False),
    T.StructField("position", T.LongType(), False),
])
