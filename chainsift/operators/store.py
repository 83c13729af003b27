"""Event store on Parquet.

Layout: ``<store>/segment=<name>/ingest_date=<d>/event=<fill|misc>/part-*.parquet``.
Every write (append, stream micro-batch, compaction, retention) makes a new
segment and then publishes one small commit file under ``<store>/_commits``
that names the (segment, day) units it adds and those it replaces. Readers
read the live units only, so a write is visible whole or not at all, a job
that dies before its commit changes nothing, and nothing is deleted before its
replacement is live (``vacuum`` removes dead folders later). Retention and
compaction name exactly the units they read; rows that arrive meanwhile are
other units and stay. Run one maintenance job at a time.

Rows are sorted by block inside files, so min/max statistics skip row groups
for block-range reads (the role of the upstream B-tree index).
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chainsift.schemas import EVENT_COLUMNS, LINEAGE_KEY, RETENTION_DAYS, STORE_COLUMNS
from chainsift.sources.storefeed import COMMITS, heads, read_commits, stream_batch

#: Columns of the data files; event, ingest_date and segment are folders.
FILE_DDL = (
    "user STRING, block BIGINT, data VARIANT, file STRING, offset BIGINT, event_pos INT, user_pos INT, "
    "created_at TIMESTAMP, run_id STRING, batch_id INT"
)
STORE_DDL = FILE_DDL + ", segment STRING, ingest_date DATE, event STRING"
ROW_DDL = (
    "user STRING, event STRING, block BIGINT, data VARIANT, file STRING, offset BIGINT, "
    "event_pos INT, user_pos INT, created_at TIMESTAMP, ingest_date DATE"
)
BACKFILL_RUN, BACKFILL_BATCH = "backfill", -1
WRITING, STATS = "_writing", "_stats"
#: Commit files from which on a stream folds them; hours for which a writer's marker protects its segment.
FOLD_AFTER, WRITER_HOURS = 64, 24
#: Files that a replay touches, up to which their names are broadcast.
BROADCAST_FILES = 1_000_000
#: Rows that compaction sorts in one task and writes as one file (about 0.5 KB each while sorted).
FILE_ROWS = 500_000


def _fs(path: str):
    from chainsift.session import filesystem

    return filesystem(path)


def with_ingest_time(events: DataFrame, created_at: Column | None = None) -> DataFrame:
    """K3: created_at defaults to the current timestamp (one value per query/micro-batch)."""
    ts = F.current_timestamp() if created_at is None else created_at
    return events.select(*EVENT_COLUMNS, ts.cast("timestamp").alias("created_at")).withColumn(
        "ingest_date", F.to_date("created_at")
    )


# --- commits -----------------------------------------------------------------

def _put(fs, path: str, value: dict) -> None:
    """Publish a small JSON file by rename: readers see it whole or not at all."""
    tmp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(tmp) as f:
        f.write(json.dumps(value).encode())
    fs.move(tmp, path)


def _commits(path: str) -> dict[str, dict]:
    return read_commits(path)


def commit(path: str, name: str, adds, replaces=(), folds=(), meta: dict | None = None) -> None:
    """Make the units ``adds`` live and ``replaces`` dead in one step (units are (segment, day) pairs)."""
    fs, base = _fs(path)
    fs.create_dir(f"{base}/{COMMITS}", recursive=True)
    at = _dt.datetime.now(_dt.timezone.utc).isoformat()
    _put(fs, f"{base}/{COMMITS}/{name}.json", {
        "adds": [list(u) for u in adds], "replaces": [list(u) for u in replaces], "folds": list(folds), "at": at, "meta": meta or {},
    })
    for segment in {name, *(u[0] for u in adds)}:
        _delete(fs, f"{base}/{WRITING}/{segment}")


def _delete(fs, path: str) -> None:
    try:
        fs.delete_file(path)
    except FileNotFoundError:
        pass


def committed(path: str, name: str) -> bool:
    return name in _commits(path)


def live_units(path: str) -> list[tuple[str, str]]:
    """(segment, day) units that readers see, sorted."""
    commits = _commits(path).values()
    dead = {tuple(u[:2]) for c in commits for u in c["replaces"]}
    return sorted({tuple(u) for c in commits for u in c["adds"]} - dead)


def fold_commits(path: str) -> None:
    """A checkpoint of the commit log: one file that stands for all commit files; the old ones go after it is published.

    It holds the live units, per stream the highest batch (a late retry of an
    earlier one is still skipped), and what the commits say of deliveries.
    Units that were replaced stay listed for a day, so that a fold that ran
    beside this one, and has not seen the replacement, cannot bring them back.
    """
    before = _commits(path)
    now = _dt.datetime.now(_dt.timezone.utc)
    old = (now - _dt.timedelta(days=1)).isoformat()
    dead = {tuple(u[:2]): (u[2] if len(u) > 2 else c["at"]) for c in before.values() for u in c["replaces"]}
    adds = sorted({tuple(u) for c in before.values() for u in c["adds"]} - dead.keys())
    in_order = sorted(before.items(), key=lambda x: (x[1]["at"], x[0]))
    meta: dict = {"upto": heads(before), "live": {}, "changes": {}, "covers": {}}
    left = {u[0] for u in adds}
    for _, c in in_order:
        meta["covers"].update({s: v for s, v in c["meta"].get("covers", {}).items() if s in left})
        meta["live"].update(c["meta"].get("live", {}))
        for stream, own in c["meta"].get("changes", {}).items():
            have = meta["changes"].setdefault(stream, {"folders": [], "log": None})
            have["folders"] = sorted({*have["folders"], *own["folders"]})
            have["log"] = own["log"]
    name = f"fold-{uuid.uuid4().hex[:12]}"
    commit(path, name, adds, [(*u, at) for u, at in sorted(dead.items()) if at >= old], before, meta)
    fs, base = _fs(path)
    for n in before:
        _delete(fs, f"{base}/{COMMITS}/{n}.json")


def tidy_commits(path: str, commits: dict[str, dict]) -> None:
    """Fold once the log has FOLD_AFTER files, so that a reader opens a bounded number of them however many batches there were."""
    if len(commits) >= FOLD_AFTER:
        fold_commits(path)


def batch_done(path: str, name: str, commits: dict[str, dict] | None = None) -> bool:
    """Whether a stream batch's commit exists, itself or folded (batches of a stream are committed in their order)."""
    commits = _commits(path) if commits is None else commits
    return name in commits or any(int(name[-10:]) <= c["meta"].get("upto", {}).get(name[:-11], -1) for c in commits.values())


def vacuum(path: str, grace_hours: float = 1.0) -> int:
    """Delete segment days that no commit holds live and that are older than ``grace_hours`` (running readers keep theirs).

    A segment that is being written has a marker and is left alone until its
    commit, whatever the grace; the marker of a dead writer counts for
    WRITER_HOURS after the writer's start.
    """
    import pyarrow.fs as pafs

    fs, base = _fs(path)
    live = set(live_units(path))
    limit = _dt.datetime.now(_dt.timezone.utc) - _dt.timedelta(hours=grace_hours)
    gone = 0
    started = _dt.datetime.now(_dt.timezone.utc) - _dt.timedelta(hours=WRITER_HOURS)
    writing = {m.base_name for m in fs.get_file_info(pafs.FileSelector(f"{base}/{WRITING}", allow_not_found=True)) if m.mtime is None or m.mtime > started}
    live |= set(live_units(path))  # what was committed between the two looks
    for seg in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if not seg.base_name.startswith("segment=") or seg.base_name[8:] in writing:
            continue
        inside = [d for d in fs.get_file_info(pafs.FileSelector(seg.path, allow_not_found=True)) if d.type == pafs.FileType.Directory]
        days = [d for d in inside if d.base_name.startswith("ingest_date=")]
        dead = [d for d in days if (seg.base_name[8:], d.base_name.split("=", 1)[-1]) not in live and (grace_hours <= 0 or d.mtime is None or d.mtime <= limit)]
        for d in dead:
            fs.delete_dir(d.path)
            gone += 1
        if len(dead) == len(days) and (grace_hours <= 0 or seg.mtime is None or seg.mtime <= limit):
            fs.delete_dir(seg.path)
            stats = f"{base}/{STATS}/{seg.base_name}"
            if fs.get_file_info(stats).type == pafs.FileType.Directory:
                fs.delete_dir(stats)
    return gone


# --- reads and writes ----------------------------------------------------------

def create_store(spark: SparkSession, path: str) -> None:
    """K2: create the store folder if absent (idempotent); writers hold to its fixed schema (ROW_DDL)."""
    fs, base = _fs(path)
    fs.create_dir(f"{base}/{COMMITS}", recursive=True)


def check_rows(rows: DataFrame) -> DataFrame:
    """K2: the rows in the store's schema; a missing column or another type is refused."""
    want = T._parse_datatype_string(ROW_DDL)
    have = {f.name: f.dataType for f in rows.schema.fields}
    for f in want.fields:
        if have.get(f.name) != f.dataType:
            raise ValueError(f"store column {f.name}: expected {f.dataType.simpleString()}, got {have.get(f.name) and have[f.name].simpleString()}")
    return rows.select(*STORE_COLUMNS)


def require_lineage(rows: DataFrame) -> DataFrame:
    """Fails the job on a NULL in the lineage key: without it rows cannot be told apart."""
    bad = F.raise_error(F.lit("lineage key (file, offset, event_pos, user_pos) must not be NULL"))
    known = F.when(F.col("file").isNull() | F.col("offset").isNull() | F.col("event_pos").isNull() | F.col("user_pos").isNull(), bad.cast("string")).otherwise(F.col("file"))
    return rows.withColumn("file", known)


def write_segment(rows: DataFrame, path: str, segment: str) -> list[tuple[str, str]]:
    """Write rows (STORE_COLUMNS, run_id, batch_id) as an unpublished segment; returns its units. Rewrites a dead attempt."""
    import pyarrow.fs as pafs

    target = f"{path.rstrip('/')}/segment={segment}"
    root, top = _fs(path)
    root.create_dir(f"{top}/{WRITING}", recursive=True)
    with root.open_output_stream(f"{top}/{WRITING}/{segment}") as f:  # ``vacuum`` leaves the segment alone until its commit
        f.write(b"{}")
    rows.write.mode("overwrite").partitionBy("ingest_date", "event").parquet(target)
    fs, base = _fs(target)
    days = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted((segment, d.base_name.split("=", 1)[1]) for d in days if d.base_name.startswith("ingest_date="))


def append_events(rows: DataFrame, path: str, run_id: str = BACKFILL_RUN, batch_id: int = BACKFILL_BATCH) -> None:
    """K1: append store rows as one published segment; an empty input adds no unit.

    Rows are sorted by block inside the input's own partitions: the log is
    read in block order, so files cover narrow block ranges without a
    shuffle, and the input is computed once. ``compact_day`` clusters a day.
    """
    name = f"{run_id}-{uuid.uuid4().hex[:12]}"
    r = require_lineage(check_rows(rows)).withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(batch_id)})
    units = write_segment(r.sortWithinPartitions("ingest_date", "event", "block", *LINEAGE_KEY), path, name)
    commit(path, name, units)


def read_units(spark: SparkSession, path: str, units) -> DataFrame:
    base = path.rstrip("/")
    paths = [f"{base}/segment={s}/ingest_date={d}" for s, d in units]
    if not paths:
        return spark.createDataFrame([], STORE_DDL)
    return spark.read.schema(STORE_DDL).option("basePath", base).parquet(*paths)


def read_store(spark: SparkSession, path: str, from_day: _dt.date | None = None) -> DataFrame:
    """The live rows with their fixed schema; filters on block / day / event reach the scan."""
    units = [u for u in live_units(path) if from_day is None or u[1] >= from_day.isoformat()]
    return read_units(spark, path, units)


def covered(commits: dict[str, dict], segment: str) -> dict[str, list[int]] | None:
    """The stream batches whose rows a segment may hold, as {stream: [lowest, highest]}; None if the log does not tell."""
    own = stream_batch(segment)
    if own:
        return {own[0]: [own[1], own[1]]}
    for c in commits.values():
        if segment in c["meta"].get("covers", {}):
            return c["meta"]["covers"][segment]
    return {} if segment.startswith(f"{BACKFILL_RUN}-") else None


def _covers(path: str, units) -> dict | None:
    """What the merged units cover together; None if that of one of them is unknown."""
    commits, out = _commits(path), {}
    for segment in {u[0] for u in units}:
        part = covered(commits, segment)
        if part is None:
            return None
        for stream, (lo, hi) in part.items():
            have = out.get(stream, [lo, hi])
            out[stream] = [min(lo, have[0]), max(hi, have[1])]
    return out


def _covering(path: str, name: str, units) -> dict:
    covers = _covers(path, units)
    return {} if covers is None else {"covers": {name: covers}}


def read_batches(spark: SparkSession, path: str, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """The live rows of stream batches, ``ranges`` = {"<run>-<event>": (after, up to)}, wherever compaction has put them.

    Only segments that may hold such a batch are read: a stream's own, and
    merged ones whose commit says that they took it in.
    """
    commits = _commits(path)
    dead = {tuple(u[:2]) for c in commits.values() for u in c["replaces"]}
    live = sorted({tuple(u) for c in commits.values() for u in c["adds"]} - dead)

    def wanted(segment: str) -> bool:
        cover = covered(commits, segment)
        return cover is None or any(s in ranges and lo <= ranges[s][1] and hi > ranges[s][0] for s, (lo, hi) in cover.items())

    may = {s: wanted(s) for s in {u[0] for u in live}}
    rows = read_units(spark, path, [u for u in live if may[u[0]]])
    inside = F.lit(False)
    for stream, (after, upto) in sorted(ranges.items()):
        run, event = stream.rsplit("-", 1)
        inside |= (F.col("run_id") == run) & (F.col("event") == event) & (F.col("batch_id") > after) & (F.col("batch_id") <= upto)
    return rows.where(inside)


def retain(store: DataFrame, as_of: _dt.datetime, keep_days: int = RETENTION_DAYS) -> DataFrame:
    """Rows with created_at >= as_of - keep (a row exactly at the cutoff stays)."""
    cutoff = as_of - _dt.timedelta(days=keep_days)
    return store.where(
        (F.col("ingest_date") >= F.lit(cutoff.date())) & (F.col("created_at") >= F.lit(cutoff))
    )


def expired_count(store: DataFrame, as_of: _dt.datetime, keep_days: int = RETENTION_DAYS) -> DataFrame:
    """A4: number of rows a cleanup at ``as_of`` removes; the day predicate keeps the other days unread."""
    cutoff = as_of - _dt.timedelta(days=keep_days)
    old = store.where((F.col("ingest_date") <= F.lit(cutoff.date())) & (F.col("created_at") < F.lit(cutoff)))
    return old.agg(F.count(F.lit(1)).alias("removed"))


def apply_retention(spark: SparkSession, path: str, as_of: _dt.datetime, keep_days: int = RETENTION_DAYS) -> int:
    """Take expired rows out in one commit; returns the number removed.

    Days before the cutoff day go whole; the boundary day's survivors are
    written as a new segment first. A job that dies before the commit leaves
    the store as it was, after it the work is done.
    """
    cutoff = as_of - _dt.timedelta(days=keep_days)
    day = cutoff.date().isoformat()
    units = live_units(path)
    old, edge = [u for u in units if u[1] < day], [u for u in units if u[1] == day]
    if not old and not edge:
        return 0
    removed = int(expired_count(read_units(spark, path, old + edge), as_of, keep_days).first()["removed"])
    if not removed:
        return 0
    name, adds = f"retention-{uuid.uuid4().hex[:12]}", []
    if edge:
        left = read_units(spark, path, edge).where(F.col("created_at") >= F.lit(cutoff)).drop("segment")
        adds = write_segment(left.sortWithinPartitions("ingest_date", "event", "block", *LINEAGE_KEY), path, name)
    commit(path, name, adds, old + edge, meta=_covering(path, name, edge))
    return removed


def compact_day(spark: SparkSession, path: str, day: _dt.date, target_rows_per_file: int = FILE_ROWS) -> int:
    """Rewrite one day's segments (appends and stream batches) into one of block-ordered files of ~target rows.

    Rows are range-partitioned on (event, block, lineage key), keep their
    run_id and batch_id as columns, and replace exactly the units that were
    read. A task sorts the rows of one file, so its memory follows the target
    and not the day. Returns the row count.
    """
    from chainsift.operators.pages import store_stats

    units = [u for u in live_units(path) if u[1] == day.isoformat()]
    rows = read_units(spark, path, units).drop("segment")
    n = rows.count() if units else 0
    if n == 0:
        return 0
    files = max(1, -(-n // target_rows_per_file))
    name = f"compact-{uuid.uuid4().hex[:12]}"
    key = ["event", "block", *LINEAGE_KEY]
    adds = write_segment(rows.repartitionByRange(files, *key).sortWithinPartitions("ingest_date", *key), path, name)
    store_stats(spark, path, name, adds)
    commit(path, name, adds, units, meta=_covering(path, name, units))
    fold_commits(path)
    return n


def dedupe(events: DataFrame, replay: DataFrame | None = None) -> DataFrame:
    """Drop replayed copies by the lineage key (deterministic per source line).

    With ``replay`` (rows read again from saved positions) only files that the
    replay touches can hold copies: the other rows pass by unshuffled.
    """
    if replay is None:
        return require_lineage(events).dropDuplicates(LINEAGE_KEY)
    touched = replay.select("file").distinct()  # hour files since the saved position
    if touched.count() <= BROADCAST_FILES:
        touched = F.broadcast(touched)
    both = require_lineage(events.join(touched, "file", "left_semi").unionByName(replay)).dropDuplicates(LINEAGE_KEY)
    return events.join(touched, "file", "left_anti").unionByName(both)
