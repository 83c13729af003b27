"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Output columns are typed projections (no VARIANT, no JSON text) so they can be
compared with the SQL in ``chainsift.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chainsift.operators import query as Q
from chainsift.operators.membership import events_with_any_member, whitelisted
from chainsift.operators.parse import bad_lines as _bad_lines
from chainsift.plans import common as C
from chainsift.plans.streams import STREAM_QUERIES
from chainsift.schemas import FILL_TYPE, MISC_TYPE
from chainsift.sources import fixtures

# Fixed parameters of the page queries.
PAGE_START, PAGE_END, PAGE_NO, PAGE_SIZE = 696373000, 696375000, 3, 100


def q_fill_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid fill event."""
    return C.fill_columns(C.fill_events(spark, sf_dir))


def q_misc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every misc user row (before membership)."""
    return C.misc_columns(C.misc_payload(C.misc_rows(spark, sf_dir)))


def q_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected lines of both types with a reason."""
    f = _bad_lines(C.lines(spark, sf_dir, FILL_TYPE), "fill")
    m = _bad_lines(C.lines(spark, sf_dir, MISC_TYPE), "misc")
    return f.unionByName(m).select("file", "reason")


def q_whitelisted_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 (flagship): fills of whitelisted users."""
    return C.fill_columns(C.whitelisted_fills(spark, sf_dir))


def q_whitelisted_misc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 row level: misc rows of whitelisted users, payload built after the join."""
    return C.misc_columns(C.whitelisted_misc(spark, sf_dir))


def q_misc_events_any_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 event level: misc events with >= 1 whitelisted user."""
    rows = whitelisted(C.misc_rows(spark, sf_dir), fixtures.whitelist(spark, sf_dir))
    return events_with_any_member(rows).select("block", "event_pos", "watched_users")


def q_all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitelisted fills and misc in one table with their lineage."""
    return C.all_events(spark, sf_dir).select("user", "event", "block", "file", "event_pos", "user_pos")


def q_events_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 (size 100) of store events with block in [start, end]."""
    page = Q.events_by_block(C.store(spark, sf_dir), PAGE_START, PAGE_END, PAGE_NO, PAGE_SIZE)
    return page.select("user", "event", "block", "event_pos", "user_pos")


def q_events_by_block_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: second keyset page; the cursor is the last row of the first page."""
    st = C.store(spark, sf_dir)
    first = Q.events_after(st, PAGE_START, PAGE_END, None, PAGE_SIZE).select(*Q.PAGE_ORDER).collect()
    cursor = first[-1].asDict() if first else None
    if cursor is None:
        return st.limit(0).select("user", "event", "block", "event_pos", "user_pos")
    return Q.events_after(st, PAGE_START, PAGE_END, cursor, PAGE_SIZE).select(
        "user", "event", "block", "event_pos", "user_pos"
    )


def q_events_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page in the middle of all stored events, found by file statistics.

    The even blocks are compacted into 16 files, whose statistics are stored;
    the odd ones are one append, whose footers are read.
    """
    import uuid

    from chainsift.operators.pages import deep_page
    from chainsift.operators.store import append_events, compact_day
    from chainsift.schemas import STORE_COLUMNS
    from chainsift.session import sub_dir

    path, rows = sub_dir(spark, "written", uuid.uuid4().hex), C.store(spark, sf_dir).select(*STORE_COLUMNS)
    n = rows.count()
    append_events(rows.where("block % 2 = 0"), path)
    compact_day(spark, path, C.INGEST_TS.date(), target_rows_per_file=max(1, n // 32))
    append_events(rows.where("block % 2 = 1"), path)
    page = deep_page(spark, path, 0, 2**62, n // 2 // PAGE_SIZE + 1, PAGE_SIZE)
    return page.select("user", "event", "block", "event_pos", "user_pos")


def q_latest_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: block of the last decodable fill line (file order); the newest hours only, older ones if they hold no valid line."""
    return C.newest_height(spark, fixtures.height_root(spark, sf_dir))


def q_max_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.max_height(C.decoded_fills(spark, sf_dir))


# --- retention -------------------------------------------------------------

def _retention_store(spark: SparkSession, sf_dir: str) -> str:
    import uuid

    from chainsift.operators.store import append_events
    from chainsift.session import sub_dir

    path = sub_dir(spark, "retention", uuid.uuid4().hex)
    append_events(fixtures.stored_events(spark, sf_dir), path)
    return path


def q_retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left after an in-place cleanup at AS_OF (7 days kept)."""
    from chainsift.operators.store import apply_retention, read_store

    path = _retention_store(spark, sf_dir)
    apply_retention(spark, path, C.AS_OF)
    st = read_store(spark, path)
    return st.select("user", "block", F.try_variant_get("data", "$.oid", "bigint").alias("oid"))


def q_cleanup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: rows of a written store that a cleanup at AS_OF removes."""
    from chainsift.operators.store import expired_count, read_store

    return expired_count(read_store(spark, _retention_store(spark, sf_dir)), C.AS_OF)


# --- whitelist -------------------------------------------------------------

WL_LO, WL_HI = 5.0, 10.0
WL_CURSOR = (7.0, "0x" + format(700, "x").rjust(40, "0"))
WL_PAGE_SIZE = 50
WL_DELTA_CURSOR, WL_DELTA_UNTIL = 5.0, 12.0


def q_whitelist_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with 5 < score <= 10."""
    from chainsift.operators.membership import whitelist_range

    return whitelist_range(fixtures.whitelist(spark, sf_dir), WL_LO, WL_HI, lo_open=True)


def q_whitelist_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3 L4: the page after cursor (score 7, address of 700), 50 members."""
    from chainsift.operators.membership import whitelist_page

    return whitelist_page(fixtures.whitelist(spark, sf_dir), WL_CURSOR, WL_PAGE_SIZE)


def q_whitelist_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: members in (5, 12] and the cursor after loading them."""
    from chainsift.operators.membership import whitelist_delta

    d, nxt = whitelist_delta(fixtures.whitelist(spark, sf_dir), WL_DELTA_CURSOR, WL_DELTA_UNTIL)
    return d.withColumn("next_cursor", F.lit(nxt))


def _wl_delta_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainsift.functions import address
    from chainsift.sources.tables import table

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    new = F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") > 5000)
    return c.where(new).select(
        address("c_custkey").alias("address"), (F.col("c_nationkey") + 100).cast("double").alias("score")
    )


def q_whitelist_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUILDING members merged with a delta (BUILDING or MACHINERY customers with balance > 5000, score + 100)."""
    from chainsift.operators.membership import whitelist_merge

    return whitelist_merge(fixtures.whitelist(spark, sf_dir), _wl_delta_table(spark, sf_dir))


def q_whitelist_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 in bulk: score of every member seen in valid fills."""
    from chainsift.operators.membership import member_scores

    return member_scores(C.fill_events(spark, sf_dir), fixtures.whitelist(spark, sf_dir))


# --- Bloom -----------------------------------------------------------------

def q_bloom_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: blocks of the whitelist at the service's sizing (10^8 items, 1 %)."""
    from chainsift.operators.bloom import bloom_build, bloom_params

    m, k = bloom_params()
    return bloom_build(fixtures.whitelist(spark, sf_dir), m, k)


def q_bloom_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 with incremental adds: a stored filter that takes the whitelist in as two deltas, split at the middle score."""
    import uuid

    from chainsift.operators.bloom import BloomStore
    from chainsift.session import sub_dir

    wl = fixtures.whitelist(spark, sf_dir)
    middle = wl.agg(F.avg("score").alias("s")).first()["s"]
    store = BloomStore(spark, sub_dir(spark, "bloom", uuid.uuid4().hex[:12]))
    store.add(wl.where(F.col("score") <= middle))
    store.add(wl.where(F.col("score") > middle))
    return store.bits()


def q_bloom_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid fills whose user passes the Bloom probe at the service's sizing."""
    from chainsift.operators.bloom import bloom_build, bloom_params, bloom_prefilter

    m, k = bloom_params()
    wl = fixtures.whitelist(spark, sf_dir)
    bits = bloom_build(wl, m, k)
    return C.fill_columns(bloom_prefilter(C.fill_events(spark, sf_dir), bits, m, k))


# Sizing of the small filter: bits for 250 items at 1 %, whatever the list's length, so false positives are certain.
SMALL_ITEMS = 250


def q_bloom_prefilter_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same probe with a filter sized for 250 items: false positives pass, members always do."""
    from chainsift.operators.bloom import bloom_build, bloom_params, bloom_prefilter

    m, k = bloom_params(SMALL_ITEMS)
    bits = bloom_build(fixtures.whitelist(spark, sf_dir), m, k)
    return C.fill_columns(bloom_prefilter(C.fill_events(spark, sf_dir), bits, m, k))


# --- subscriptions ---------------------------------------------------------

def q_active_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-action-wins subscription state."""
    from chainsift.operators.subscriptions import active_subscriptions

    return active_subscriptions(fixtures.subscription_log(spark, sf_dir))


def q_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whitelisted event for every client subscribed to its type."""
    from chainsift.operators.subscriptions import active_subscriptions, fan_out

    act = active_subscriptions(fixtures.subscription_log(spark, sf_dir))
    return fan_out(C.all_events(spark, sf_dir).drop("data"), act).select(
        "client_id", "user", "event", "block", "event_pos", "user_pos"
    )


def q_temporal_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitelisted fills delivered to clients subscribed at the fill's time."""
    from chainsift.operators.subscriptions import temporal_delivery

    ev = C.whitelisted_fills(spark, sf_dir).withColumn(
        "ts", F.timestamp_millis(F.try_variant_get("data", "$.time", "bigint"))
    )
    out = temporal_delivery(ev.drop("data"), fixtures.subscription_log(spark, sf_dir), "ts")
    return out.select("client_id", "user", "event", "block", "event_pos")


# --- paths and positions ---------------------------------------------------

def q_hour_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour file decoded to (type, date, hour) and rebuilt from its hour."""
    from chainsift.functions import decode_path, hour_path

    from chainsift.sources.blocklog import list_block_log

    files = list_block_log(spark, fixtures.fixture_root(spark, sf_dir)).select("file")
    d = decode_path("file")
    return files.select(
        "file", d["type"].alias("log_type"), d["date"].alias("date"), d["hour"].alias("hour"),
        hour_path(d["type"], d["hour_ts"]).alias("rebuilt"),
    )


def q_files_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour path from the first fill hour to the last, and whether it exists."""
    from chainsift.functions import decode_path
    from chainsift.operators.positions import files_between

    from chainsift.sources.blocklog import list_block_log

    existing = list_block_log(spark, fixtures.fixture_root(spark, sf_dir), [FILL_TYPE]).select("file")
    h = F.unix_seconds(decode_path("file")["hour_ts"])
    bounds = existing.select(h.alias("h")).agg(F.min("h").alias("a"), F.max("h").alias("b")).first()
    paths = files_between(spark, FILL_TYPE, bounds["a"], bounds["b"])
    ex = existing.select(F.col("file").alias("_f"), F.lit(True).alias("_e"))
    return paths.join(ex, paths["file"] == ex["_f"], "left").select(
        "file", F.coalesce(F.col("_e"), F.lit(False)).alias("exists")
    )


def q_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 K5: per fill file, bytes consumed after reading it whole."""
    from chainsift.operators.positions import positions

    return positions(C.lines(spark, sf_dir, FILL_TYPE))


def q_resume_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill events read from a saved position (middle block of the log) onward."""
    return C.fill_columns(C.resumed_fills(spark, sf_dir))


def q_dedupe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay from the saved position appended twice, removed by the lineage key."""
    from chainsift.operators.membership import whitelisted
    from chainsift.operators.store import dedupe

    wl = fixtures.whitelist(spark, sf_dir)
    once = C.whitelisted_fills(spark, sf_dir)
    replay = whitelisted(C.resumed_fills(spark, sf_dir), wl)
    return C.fill_columns(dedupe(once, replay))


def q_text_fill_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 via the built-in JVM text reader (closed files read whole): same events as fill_events."""
    from chainsift.operators.explode import explode_fills
    from chainsift.operators.parse import parse_fills
    from chainsift.sources.text import scan_text

    lines = scan_text(spark, fixtures.fixture_root(spark, sf_dir), [FILL_TYPE])
    return C.fill_columns(explode_fills(parse_fills(lines)))


def q_saved_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save the fill log's resume position (last file, bytes read) and load it back."""
    import uuid

    from chainsift.operators.positions import newest_lines, save_positions, saved
    from chainsift.session import sub_dir

    path = sub_dir(spark, "positions", uuid.uuid4().hex)
    save_positions(newest_lines(spark, fixtures.fixture_root(spark, sf_dir), FILL_TYPE), path)
    return saved(spark, path).select("file", "position")


def q_page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 of the store's fills as one JSON array, then read back."""
    st = C.store(spark, sf_dir).where(F.col("event") == "fill")
    page = Q.page_json(Q.events_by_block(st, PAGE_START, PAGE_END, PAGE_NO, PAGE_SIZE))
    item = F.explode(F.from_json("json", "array<struct<user:string,event:string,block:bigint,data:struct<coin:string,px:string,oid:bigint,tid:bigint>>>"))
    return page.select(item.alias("e")).select("e.user", "e.event", "e.block", "e.data.coin", "e.data.px", "e.data.oid", "e.data.tid")


def q_member_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, point form: the score of the whitelist's smallest address."""
    from chainsift.operators.membership import member_score

    wl = fixtures.whitelist(spark, sf_dir)
    first = wl.agg(F.min("address").alias("a")).first()["a"] or ""
    return member_score(wl, first).select(F.lit(first).alias("address"), "score")


def q_disconnect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscription state where every purchase event closes the client's connection."""
    from chainsift.operators.subscriptions import active_subscriptions

    log = fixtures.subscription_log(spark, sf_dir)
    closed = F.when(F.col("action") == "purchase", F.lit("disconnect")).otherwise(F.col("action"))
    return active_subscriptions(log.withColumn("action", closed))


def q_empty_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: a created store takes rows of its schema only; rows by event type after a refused and an accepted append."""
    import uuid

    from chainsift.operators.store import append_events, create_store, read_store
    from chainsift.session import sub_dir

    path = sub_dir(spark, "created", uuid.uuid4().hex)
    create_store(spark, path)
    rows = fixtures.stored_events(spark, sf_dir)
    try:
        append_events(rows.withColumn("block", F.col("block").cast("string")), path)
    except ValueError:
        append_events(rows, path)
    return read_store(spark, path).groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.max("block").alias("top"))


def q_store_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store compaction: stream batches of the fills and appends of the misc events, merged into block-ordered files; rows unchanged."""
    import uuid

    from chainsift.operators.store import append_events, compact_day, read_store, with_ingest_time
    from chainsift.plans.streams import bounded_run
    from chainsift.session import sub_dir

    path = bounded_run(spark, sf_dir, "compaction", parts=4).store_path
    staged = sub_dir(spark, "compaction", uuid.uuid4().hex)
    # Parse once into a staging table (cuts the lineage); the appends read it back.
    with_ingest_time(C.whitelisted_misc(spark, sf_dir), F.lit(C.INGEST_TS)).write.parquet(staged)
    rows = spark.read.parquet(staged)
    for i in range(2):
        append_events(rows.where(F.col("block") % 2 == i), path)
    compact_day(spark, path, C.INGEST_TS.date())
    return read_store(spark, path).select("user", "event", "block", "file", "event_pos", "user_pos")


# Registry, in report order.
QUERIES = {
    "whitelisted_fills": q_whitelisted_fills,
    "fill_events": q_fill_events,
    "misc_events": q_misc_events,
    "bad_lines": q_bad_lines,
    "whitelisted_misc": q_whitelisted_misc,
    "misc_events_any_user": q_misc_events_any_user,
    "all_events": q_all_events,
    "events_by_block": q_events_by_block,
    "events_by_block_seek": q_events_by_block_seek,
    "events_page_deep": q_events_page_deep,
    "latest_height": q_latest_height,
    "max_height": q_max_height,
    "saved_positions": q_saved_positions,
    "store_compaction": q_store_compaction,
    "text_fill_events": q_text_fill_events,
    "retained_events": q_retained_events,
    "cleanup_count": q_cleanup_count,
    "whitelist_range": q_whitelist_range,
    "whitelist_page": q_whitelist_page,
    "whitelist_delta": q_whitelist_delta,
    "whitelist_merge": q_whitelist_merge,
    "whitelist_score": q_whitelist_score,
    "bloom_build": q_bloom_build,
    "bloom_incremental": q_bloom_incremental,
    "bloom_prefilter": q_bloom_prefilter,
    "bloom_prefilter_small": q_bloom_prefilter_small,
    "page_json": q_page_json,
    "member_score": q_member_score,
    "disconnect": q_disconnect,
    "empty_store": q_empty_store,
    "active_subscriptions": q_active_subscriptions,
    "fan_out": q_fan_out,
    "temporal_delivery": q_temporal_delivery,
    "hour_paths": q_hour_paths,
    "files_between": q_files_between,
    "positions": q_positions,
    "resume_from": q_resume_from,
    "dedupe_replay": q_dedupe_replay,
    **STREAM_QUERIES,
}
