"""Block-event analytics on Spark.

Reads hourly JSON-lines block logs (batch or stream), validates and explodes
them into one row per user event, keeps events of whitelisted addresses, and
serves a Parquet event store: block-range pages, height, retention and
subscriber fan-out. Everything is DataFrame -> DataFrame.
"""

__all__ = ["session", "schemas"]
