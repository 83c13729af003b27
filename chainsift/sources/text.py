"""S1 with Spark's built-in text reader (JVM): whole closed files, no byte offsets.

Splits only at ``\\n`` (the default also splits at a lone ``\\r``). Rows carry
the relative hour-file path from ``_metadata.file_path``; ``offset`` is NULL,
so the lineage key is incomplete: use it for full re-reads of closed hours
(the store and ``dedupe`` refuse its rows), the ``blocklog`` source when
offsets or growing files matter. Files that are no hour of a day are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chainsift.functions.paths import decode_path, rel_path
from chainsift.schemas import HOURLY_DIR, LOG_TYPES


def scan_text(spark: SparkSession, root: str, types=LOG_TYPES) -> DataFrame:
    import pyarrow.fs as pafs

    from chainsift.session import filesystem

    fs, base = filesystem(root)
    present = [t for t in types if fs.get_file_info(f"{base}/{t}/{HOURLY_DIR}").type == pafs.FileType.Directory]
    paths = [f"{root.rstrip('/')}/{t}/{HOURLY_DIR}/*/*" for t in present]
    if not paths:
        return spark.createDataFrame([], "file string, offset bigint, value string")
    df = spark.read.option("lineSep", "\n").text(paths)
    return df.select(
        rel_path(F.col("_metadata.file_path")).alias("file"), F.lit(None).cast("bigint").alias("offset"), "value"
    ).where((F.col("file") != "") & decode_path("file")["hour_ts"].isNotNull())
