"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job needs: UTC for hour folders and epoch conversions, last
# key wins on duplicate JSON keys (as the upstream decoder does), AQE with
# skew-join splitting for hot users.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Deep OFFSET pages should not keep limit+offset rows per task forever.
    "spark.sql.execution.topKSortFallbackThreshold": "1000000",
    # Partitioned writes here put one or two partition values in a task (two
    # event types, one or two ingest days): up to two open writers per task
    # instead of sorting every row by partition first.
    "spark.sql.maxConcurrentOutputFileWriters": "2",
    # Rows can be long texts: smaller batches keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def filesystem(path: str):
    """(pyarrow filesystem, path inside it) for a plain path, a ``file:`` URI or a remote URI."""
    import pyarrow.fs as pafs

    path = path.rstrip("/") or "/"
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


_SHIPPED: dict = {}  # id of a SparkContext -> its application id (ids are reused after a stop)


def ship_package(spark: SparkSession) -> None:
    """Make ``chainsift`` importable in Python workers (executors, data-source planner).

    The package is zipped (name = content hash) into the shared work folder
    and registered with ``addPyFile`` once per SparkContext.
    """
    import hashlib
    import io
    import zipfile

    import pyarrow.fs as pafs

    sc = spark.sparkContext
    if _SHIPPED.get(id(sc)) == sc.applicationId:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    files = []
    for d, _, names in os.walk(pkg):
        for n in sorted(names):
            if n.endswith(".py"):
                full = os.path.join(d, n)
                files.append((os.path.relpath(full, os.path.dirname(pkg)), open(full, "rb").read()))
    files.sort()
    digest = hashlib.sha1(b"".join(a.encode() + b for a, b in files)).hexdigest()[:12]
    target = f"{work_dir(spark)}/pyfiles/chainsift-{digest}.zip"
    fs, path = filesystem(target)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in files:
                z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        tmp = f"{path}.{os.getpid()}.tmp"
        with fs.open_output_stream(tmp) as out:
            out.write(buf.getvalue())
        fs.move(tmp, path)
    sc.addPyFile(target)
    _SHIPPED[id(sc)] = sc.applicationId


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to an existing session and ship the package."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    ship_package(spark)
    from chainsift.sources import blocklog, storefeed

    blocklog.register(spark)
    storefeed.register(spark)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "chainsift") -> SparkSession:
    """A local session for tests and benchmarks (UI off, no ports beyond Spark's own)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written tables and lineage cuts.

    Uses the cluster's ``spark.checkpoint.dir``. Only when it is unset (local
    tests on a local master) a fresh folder is created and registered.
    """
    try:
        d = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # pragma: no cover - conf not visible through SQL conf
        d = None
    if not d:
        d = spark.sparkContext.getCheckpointDir()
        if d:
            # SparkContext appends a random UUID folder; its parent is the configured dir.
            d = os.path.dirname(d.rstrip("/"))
    if not d and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if not d:
        d = tempfile.mkdtemp(prefix="chainsift-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def sub_dir(spark: SparkSession, *parts: str) -> str:
    return "/".join([work_dir(spark), *parts])
