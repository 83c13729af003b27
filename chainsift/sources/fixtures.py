"""Block logs, whitelist, subscription log and stored events derived from the test tables.

Every fixture is a Spark job over the given tables, so its size follows them.
Line text is assembled with ``concat`` so an SQL engine can rebuild the exact
bytes (needed for byte-offset checks). Rules (block = base + key div 4, bad
lines and elements by modulus, whitelist = BUILDING customers, ...) are the
project's fixture definition.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chainsift.functions import address, hour_path, iso_nanos
from chainsift.schemas import FILL_TYPE, MISC_TYPE
from chainsift.session import sub_dir
from chainsift.sources.tables import table  # noqa: F401  (re-exported)

# Fixed fixture values.
BASE_BLOCK = 696372899
# Bump when the line format changes, so cached hour files are not reused.
FIXTURE_VERSION = "v2-r2"
TID_BASE = 320000000000000001
# Table rows whose lines one writing task sorts.
WRITER_ROWS = 400_000
COIN_BY_EVENT_TYPE = {"click": "BTC", "view": "ETH", "purchase": "SUI"}  # anything else: XRP


def _q(c: Column) -> Column:
    """JSON string literal of a column whose text needs no escaping."""
    return F.concat(F.lit('"'), c, F.lit('"'))


def fill_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fill tuple text per `events` row: (block, event_id, ts, elem)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    eid = F.col("event_id")
    coin = F.coalesce(
        *[F.when(F.col("event_type") == k, F.lit(v)) for k, v in COIN_BY_EVENT_TYPE.items()], F.lit("XRP")
    )
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    payload = F.concat(
        F.lit('{"coin":'), _q(coin),
        F.lit(',"px":'), _q(F.col("value").cast("decimal(18,2)").cast("string")),
        F.lit(',"sz":'), _q((eid % 1000 + 1).cast("string")),
        F.lit(',"side":'), _q(F.when(eid % 2 == 0, F.lit("B")).otherwise(F.lit("A"))),
        F.lit(',"time":'), ms.cast("string"),
        F.lit(',"oid":'), eid.cast("string"),
        F.lit(',"crossed":'), F.when(eid % 3 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit(',"tid":'), (F.lit(TID_BASE) + eid).cast("string"),
        F.lit(',"twapId":null}'),
    )
    user = _q(address("user_id"))
    elem = (
        F.when(eid % 53 == 0, F.concat(F.lit("[7,"), payload, F.lit("]")))
        .when(eid % 59 == 0, F.concat(F.lit("["), user, F.lit("]")))
        .when(eid % 61 == 0, F.concat(F.lit("["), user, F.lit(","), payload, F.lit(",9]")))
        .when(eid % 67 == 0, F.concat(F.lit("["), user, F.lit(",[1]]")))
        .otherwise(F.concat(F.lit("["), user, F.lit(","), payload, F.lit("]")))
    )
    return e.select((F.lit(BASE_BLOCK) + F.floor(eid / 4)).cast("bigint").alias("block"), eid, "ts", elem.alias("elem"))


def _assemble(elements: DataFrame, key: str, log_type: str, bad: Column | None) -> DataFrame:
    """Group elements into one line per block (at most 4 per block by construction)."""
    blocks = elements.groupBy("block").agg(
        F.min("ts").alias("block_time"),
        F.max("ts").alias("local_time"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(F.col(key), F.col("elem")))), lambda x: x["elem"]), ","
        ).alias("events"),
    )
    good = F.concat(
        F.lit('{"local_time":'), _q(iso_nanos("local_time")),
        F.lit(',"block_time":'), _q(iso_nanos("block_time")),
        F.lit(',"block_number":'), F.col("block").cast("string"),
        F.lit(',"events":['), F.col("events"), F.lit("]}"),
    )
    value = good if bad is None else bad
    return blocks.select(hour_path(log_type, "block_time").alias("file"), "block", value.alias("value"))


def fill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill block lines (file, block, value); two kinds of bad lines by block modulus."""
    b = F.col("block")
    good_parts = F.concat(
        F.lit('{"local_time":'), _q(iso_nanos("local_time")),
        F.lit(',"block_time":'), _q(iso_nanos("block_time")),
    )
    bad = (
        F.when(b % 97 == 0, F.lit("junk {"))
        .when(b % 89 == 0, F.concat(good_parts, F.lit(',"block_number":"x","events":['), F.col("events"), F.lit("]}")))
        .otherwise(
            F.concat(good_parts, F.lit(',"block_number":'), b.cast("string"), F.lit(',"events":['), F.col("events"), F.lit("]}"))
        )
    )
    return _assemble(fill_elements(spark, sf_dir), "event_id", FILL_TYPE, bad)


def misc_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One misc event text per order: (block, o_orderkey, ts, elem)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey")
    u1 = address("o_custkey")
    n = table(spark, sf_dir, "customer").count()  # second users range over all customers
    u2 = F.when(k % 11 == 0, u1).otherwise(address(k % max(1, n)))
    usdc = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    users = F.concat(
        F.lit("["), _q(u1), F.lit(","), _q(u2),
        F.when(F.col("o_orderstatus") == "O", F.lit(",7,null")).otherwise(F.lit("")), F.lit("]"),
    )
    ledger = F.concat(
        F.lit('{"hash":"old","LedgerUpdate":{"users":'), users,
        F.lit(',"delta":{"type":"deposit","usdc":'), _q(usdc),
        F.lit(',"user":'), _q(u1), F.lit(',"destination":'), _q(u2), F.lit("}}}"),
    )
    deposit = F.concat(F.lit('{"CDeposit":{"user":'), _q(u1), F.lit(',"amount":'), _q(usdc), F.lit("}}"))
    inner = F.when(F.col("o_orderstatus") == "P", deposit).otherwise(ledger)
    elem = F.concat(
        F.lit('{"time":'), _q(iso_nanos("o_orderdate")),
        F.lit(',"hash":'), _q(F.concat(F.lit("0x"), k.cast("string"))),
        F.lit(',"inner":'), inner, F.lit("}"),
    )
    return o.select(
        (F.lit(BASE_BLOCK) + F.floor(k / 4)).cast("bigint").alias("block"), k, F.col("o_orderdate").alias("ts"), elem.alias("elem")
    )


def misc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assemble(misc_elements(spark, sf_dir), "o_orderkey", MISC_TYPE, None)


def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_lines(spark, sf_dir).unionByName(misc_lines(spark, sf_dir))


def _write_partition(root: str):
    """Task-side writer: lines arrive sorted by (file, block); one output stream per file."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        root_ = root.rstrip("/")
        if root_.startswith("file:"):
            fs, base = pafs.LocalFileSystem(), "/" + root_[len("file:"):].lstrip("/")
        elif "://" in root_:
            fs, base = pafs.FileSystem.from_uri(root_)
        else:
            fs, base = pafs.LocalFileSystem(), root_
        cur, out, n, nbytes = None, None, 0, 0
        files, counts, sizes = [], [], []

        def close():
            if out is not None:
                out.close()
                files.append(cur)
                counts.append(n)
                sizes.append(nbytes)

        for rb in batches:
            fcol = rb.column("file").to_pylist()
            vcol = rb.column("value").to_pylist()
            for f, v in zip(fcol, vcol):
                if f != cur:
                    close()
                    path = f"{base}/{f}"
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    cur, out, n, nbytes = f, fs.open_output_stream(path), 0, 0
                data = (v + "\n").encode("utf-8")
                out.write(data)
                n += 1
                nbytes += len(data)
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(files, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
            names=["file", "lines", "bytes"],
        )

    return run


def write_hour_files(lines: DataFrame, root: str, partitions: int | None = None, order=F.asc) -> DataFrame:
    """Write (file, block, value) lines as hour files under root; returns per-file counts.

    All lines of one hour file go to one task (a file has one writer, as the
    upstream node has); hours are spread over tasks by hash.
    """
    n = partitions or lines.sparkSession.sparkContext.defaultParallelism
    return (
        lines.repartition(n, "file")
        .sortWithinPartitions("file", order("block"))
        .mapInArrow(_write_partition(root), "file string, lines long, bytes long")
    )


def publish_once(spark: SparkSession, final: str, build) -> str:
    """Materialise a folder once: ``build(tmp)`` writes a fresh temp folder that is renamed into place.

    A concurrent caller that loses the rename discards its copy, so readers
    never see a folder that is still being written.
    """
    import uuid

    import pyarrow.fs as pafs

    from chainsift.session import filesystem

    fs, base = filesystem(final)
    if fs.get_file_info(f"{base}/_SUCCESS").type != pafs.FileType.NotFound:
        return final
    tmp = f"{final}.tmp-{uuid.uuid4().hex[:12]}"
    build(tmp)
    _, tbase = filesystem(tmp)
    if fs.get_file_info(f"{tbase}/_SUCCESS").type == pafs.FileType.NotFound:
        with fs.open_output_stream(f"{tbase}/_SUCCESS") as m:
            m.write(b"")
    try:
        fs.move(tbase, base)
    except OSError:
        if fs.get_file_info(f"{base}/_SUCCESS").type == pafs.FileType.NotFound:
            raise
        fs.delete_dir(tbase)  # another caller published first
    return final


def writers(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """Writing tasks for the lines of some tables: more with more rows, so that a task sorts a bounded share."""
    rows = sum(table(spark, sf_dir, n).count() for n in names)
    return max(spark.sparkContext.defaultParallelism, -(-rows // WRITER_ROWS))


def fixture_root(spark: SparkSession, sf_dir: str) -> str:
    """Hour files of both log types for sf_dir, written once per work folder."""
    tag = hashlib.sha1((FIXTURE_VERSION + sf_dir.rstrip("/")).encode()).hexdigest()[:12]
    root = sub_dir(spark, "fixtures", tag)
    return publish_once(
        spark, root, lambda tmp: write_hour_files(block_lines(spark, sf_dir), tmp, writers(spark, sf_dir, "events", "orders")).agg(F.sum("lines")).collect()
    )


def height_root(spark: SparkSession, sf_dir: str) -> str:
    """The fill log with the blocks of every hour written in falling order: its last line is not its highest block."""
    tag = hashlib.sha1((FIXTURE_VERSION + "height" + sf_dir.rstrip("/")).encode()).hexdigest()[:12]
    root = sub_dir(spark, "fixtures", tag)
    return publish_once(
        spark, root, lambda tmp: write_hour_files(fill_lines(spark, sf_dir), tmp, writers(spark, sf_dir, "events"), order=F.desc).agg(F.sum("lines")).collect()
    )


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitelist members: BUILDING customers, score = nation key (many ties on purpose)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return c.where(F.col("c_mktsegment") == "BUILDING").select(
        address("c_custkey").alias("address"), F.col("c_nationkey").cast("double").alias("score")
    )


def subscription_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw client messages (client_id, message JSON text, ts, seq): signup -> subscribe,
    error -> unsubscribe, other event types give an unknown action."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    eid = F.col("event_id")
    action = (
        F.when(F.col("event_type") == "signup", F.lit("subscribe"))
        .when(F.col("event_type") == "error", F.lit("unsubscribe"))
        .otherwise(F.col("event_type"))
    )
    event = F.when(eid % 3 == 0, F.lit("fill")).when(eid % 3 == 1, F.lit("misc")).otherwise(F.lit("bogus"))
    message = F.concat(F.lit('{"action":'), _q(action), F.lit(',"event":'), _q(event), F.lit("}"))
    return e.select(
        F.col("user_id").alias("client_id"), message.alias("message"),
        # Millisecond resolution, the resolution of event times in the log payload.
        F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts"), eid.alias("seq"),
    )


def subscription_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded subscription log (client_id, action, event, ts, seq)."""
    from chainsift.operators.subscriptions import parse_messages

    return parse_messages(subscription_messages(spark, sf_dir))


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store rows for retention tests: one fill per `events` row, created_at = ts."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    eid = F.col("event_id")
    block = (F.lit(BASE_BLOCK) + F.floor(eid / 4)).cast("bigint")
    return e.select(
        address("user_id").alias("user"),
        F.lit("fill").alias("event"),
        block.alias("block"),
        F.to_variant_object(F.struct(eid.alias("oid"))).alias("data"),
        hour_path(FILL_TYPE, "ts").alias("file"),
        block.alias("offset"),
        (eid % 4).cast("int").alias("event_pos"),
        F.lit(0).alias("user_pos"),
        F.col("ts").cast("timestamp").alias("created_at"),
    ).withColumn("ingest_date", F.to_date("created_at"))
