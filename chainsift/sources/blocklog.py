"""``blocklog`` data source: hour-file block logs with byte offsets, batch and stream.

Layout: ``<root>/<type>/hourly/<yyyymmdd>/<h>``. Rows: ``(file, offset, value)``,
one per newline-terminated line; ``offset`` is the byte position of the line
start, so ``offset + octet_length(value) + 1`` is the resume position.

Why a custom source: built-in text streaming never re-reads a file it has
seen, but hour files grow while their hour is open. The stream offset here is
``{file: bytes consumed}``; every trigger lists the hour folders at or after the
oldest open hour and reads only the new bytes, up to the last newline (a torn
last line waits for the next trigger).

Splits: files are cut into ranges of ``splitBytes``; a range owns the lines
that *start* inside it, so lines never split across tasks. Small files are
packed together so one task reads many.

Options
  path            data folder (local path or a pyarrow-supported URI)
  types           comma list of log types (default: both)
  splitBytes      largest bytes per input partition (default 64 MiB)
  parallelism     cores to spread a small input over (default 1; the read helpers pass
                  ``defaultParallelism``): split = min(splitBytes, max(openCostBytes, total / parallelism))
  openCostBytes   cost charged per file when packing small files (default 1 MiB)
  graceHours      an hour file is closed once ``hour + 1h + graceHours`` <= now;
                  only closed files give up an unterminated last line (default 1)
  now             ISO timestamp standing in for the clock (tests)
  startingPositions  JSON ``{"<rel file>": position}``; files of older hours of
                  the same type are skipped, newer ones start at 0 (catch-up)
  maxBytesPerTrigger  stream only: cap on new bytes per micro-batch (at least one file)
  startHour / endHour  ISO timestamps; only hour files in [startHour, endHour] are
                  listed and read (date folders outside are never opened): the
                  source's partition pruning for reads of a time range
"""

from __future__ import annotations

import datetime as _dt
import json
import re
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from chainsift.schemas import HOURLY_DIR, LOG_TYPES

SCHEMA = "file string, offset bigint, value string"
_DATE = re.compile(r"^[0-9]{8}$")
_HOUR = re.compile(r"^[0-9]{1,2}$")
_READ_CHUNK = 8 << 20


def _fs(root: str):
    """(pyarrow filesystem, path) for a plain path, a ``file:`` URI or a remote URI.

    Kept inside this module (not imported) because the module is pickled by value.
    """
    import pyarrow.fs as pafs

    root = root.rstrip("/") or "/"
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[len("file:"):].lstrip("/")
    if "://" in root:
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def _iso(text):
    """Aware UTC datetime of an ISO string (naive = UTC), or None."""
    if not text:
        return None
    t = _dt.datetime.fromisoformat(str(text).replace("Z", "+00:00"))
    return t if t.tzinfo is not None else t.replace(tzinfo=_dt.timezone.utc)


def _hour_key(rel: str):
    """(type, datetime of the hour) of '<type>/hourly/<date>/<h>', or None."""
    parts = rel.split("/")
    if len(parts) != 4 or parts[1] != HOURLY_DIR or not _DATE.match(parts[2]) or not _HOUR.match(parts[3]):
        return None
    try:
        ts = _dt.datetime.strptime(parts[2], "%Y%m%d").replace(tzinfo=_dt.timezone.utc)
    except ValueError:
        return None
    h = int(parts[3])
    if h > 23:
        return None
    return parts[0], ts + _dt.timedelta(hours=h)


@dataclass
class _Range:
    rel: str
    start: int
    end: int  # exclusive: lines starting before end belong to this range
    limit: int  # readable bytes of the file in this batch (end of last owned line)


class _Part(InputPartition):
    def __init__(self, ranges):
        self.ranges = ranges


class _Lister:
    """Driver-side listing of hour files and their consumable sizes."""

    def __init__(self, options):
        options = _lower(options)
        self.root = options.get("path") or options.get("root")
        if not self.root:
            raise ValueError("blocklog: option 'path' is required")
        self.types = [t for t in (options.get("types") or ",".join(LOG_TYPES)).split(",") if t]
        self.max_split = int(options.get("splitbytes", 64 << 20))
        self.parallelism = max(1, int(options.get("parallelism", 1)))
        self.open_cost = int(options.get("opencostbytes", 1 << 20))
        self.grace = _dt.timedelta(hours=float(options.get("gracehours", 1)))
        self.fixed_now = _iso(options.get("now"))
        self.start_hour = _iso(options.get("starthour"))
        self.end_hour = _iso(options.get("endhour"))

    def now(self):
        return self.fixed_now or _dt.datetime.now(_dt.timezone.utc)

    def list(self, since=None):
        """[(rel, hour_ts, size)] sorted by (type, hour); only hours >= since[type] when given."""
        import pyarrow.fs as pafs

        fs, base = _fs(self.root)
        out = []
        for t in self.types:
            tdir = f"{base}/{t}/{HOURLY_DIR}"
            info = fs.get_file_info(tdir)
            if info.type != pafs.FileType.Directory:
                continue
            floor = (since or {}).get(t)
            if self.start_hour is not None and (floor is None or floor < self.start_hour):
                floor = self.start_hour
            dates = [
                i for i in fs.get_file_info(pafs.FileSelector(tdir)) if i.type == pafs.FileType.Directory and _DATE.match(i.base_name)
            ]
            for d in dates:
                if floor is not None and d.base_name < floor.strftime("%Y%m%d"):
                    continue
                if self.end_hour is not None and d.base_name > self.end_hour.strftime("%Y%m%d"):
                    continue
                for f in fs.get_file_info(pafs.FileSelector(d.path)):
                    if f.type != pafs.FileType.File:
                        continue
                    rel = f"{t}/{HOURLY_DIR}/{d.base_name}/{f.base_name}"
                    hk = _hour_key(rel)
                    if hk is None or (floor is not None and hk[1] < floor):
                        continue
                    if self.end_hour is not None and hk[1] > self.end_hour:
                        continue
                    out.append((rel, hk[1], f.size))
        out.sort(key=lambda r: (r[0].split("/")[0], r[1]))
        return out

    def closed(self, hour_ts) -> bool:
        return hour_ts + _dt.timedelta(hours=1) + self.grace <= self.now()

    def consumable(self, rel: str, size: int, hour_ts) -> int:
        """Bytes that may be consumed now: all of a closed file, else up to its last newline."""
        if size == 0 or self.closed(hour_ts):
            return size
        fs, base = _fs(self.root)
        pos = size
        with fs.open_input_file(f"{base}/{rel}") as f:
            while pos > 0:
                n = min(1 << 16, pos)
                f.seek(pos - n)
                buf = f.read(n)
                i = buf.rfind(b"\n")
                if i >= 0:
                    return pos - n + i + 1
                pos -= n
        return 0

    def line_end(self, rel: str, start: int, budget: int, limit: int) -> int:
        """Last line end within ``budget`` bytes after ``start``; a longer first line is taken whole."""
        fs, base = _fs(self.root)
        with fs.open_input_file(f"{base}/{rel}") as f:
            pos = start + budget
            while pos > start:
                n = min(1 << 16, pos - start)
                f.seek(pos - n)
                i = f.read(n).rfind(b"\n")
                if i >= 0:
                    return pos - n + i + 1
                pos -= n
            pos = start + budget
            f.seek(pos)
            while pos < limit:
                chunk = f.read(min(1 << 16, limit - pos))
                i = chunk.find(b"\n")
                if i >= 0:
                    return pos + i + 1
                pos += len(chunk)
        return limit

    def plan(self, spans):
        """spans: [(rel, start, limit)] -> packed partitions of newline-owned ranges.

        Like Spark's file splitting: small inputs are spread over the cores,
        large ones cut at ``splitBytes``; each file also costs ``openCostBytes``.
        """
        total = sum(limit - start + self.open_cost for _, start, limit in spans)
        split = max(1, min(self.max_split, max(self.open_cost, total // self.parallelism)))
        parts, cur, cur_bytes = [], [], 0
        for rel, start, limit in spans:
            s = start
            cur_bytes += self.open_cost
            while s < limit:
                e = min(limit, s + split)
                cur.append(_Range(rel, s, e, limit))
                cur_bytes += e - s
                s = e
                if cur_bytes >= split:
                    parts.append(_Part(cur))
                    cur, cur_bytes = [], 0
        if cur:
            parts.append(_Part(cur))
        return parts


def _lines_batch(rel: str, data: bytes, pos: int, end: int):
    """Arrow batch of the lines in ``data`` (which starts at a line start, absolute ``pos``).

    Every ``\n`` in ``data`` ends a line; bytes after the last one form a final
    line. Only lines starting before ``end`` are kept. Returns (batch or None,
    stopped) where ``stopped`` says a line at or after ``end`` was seen.
    The string column is built from buffers: newlines are removed in one pass
    and line i starts at (its byte position - i) in the compacted buffer.
    """
    import numpy as np
    import pyarrow as pa

    buf = np.frombuffer(data, dtype=np.uint8)
    nl = np.flatnonzero(buf == 10)
    starts = np.empty(len(nl) + 1, dtype=np.int64)
    starts[0] = 0
    starts[1:] = nl + 1
    if starts[-1] >= len(data):  # data ends with a newline: no final partial line
        starts = starts[:-1]
    n_all = len(starts)
    n = int(np.searchsorted(starts, end - pos, side="left"))
    stopped = n < n_all
    if n == 0:
        return None, stopped
    cut = len(data) if n == n_all else int(starts[n])
    compact = data[:cut].replace(b"\n", b"")
    offs = np.empty(n + 1, dtype=np.int32)
    offs[:n] = starts[:n] - np.arange(n, dtype=np.int64)
    offs[n] = len(compact)
    values = pa.StringArray.from_buffers(n, pa.py_buffer(offs.tobytes()), pa.py_buffer(compact))
    try:
        values.validate(full=True)
    except pa.ArrowInvalid:  # invalid UTF-8: decode line by line with replacement characters
        raw = data[:cut].split(b"\n")[:n]
        values = pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())
    batch = pa.RecordBatch.from_arrays(
        [pa.array([rel] * n, pa.string()), pa.array(starts[:n] + pos, pa.int64()), values],
        names=["file", "offset", "value"],
    )
    return batch, stopped


def _read_ranges(root: str, ranges):
    """Executor side: yield Arrow batches of the lines each range owns."""
    fs, base = _fs(root)
    for r in ranges:
        path = f"{base}/{r.rel}"
        with fs.open_input_file(path) as f:
            pos = r.start
            if pos > 0:
                # The line holding byte pos-1 belongs to the previous range unless it ends there.
                f.seek(pos - 1)
                skip = b""
                while True:
                    chunk = f.read(min(_READ_CHUNK, r.limit - (pos - 1) - len(skip)))
                    if not chunk:
                        pos = r.limit
                        break
                    i = chunk.find(b"\n")
                    if i >= 0:
                        pos = pos - 1 + len(skip) + i + 1
                        break
                    skip += chunk
            if pos >= r.end:
                continue
            f.seek(pos)
            carry = b""
            while pos < r.end:
                want = min(_READ_CHUNK, r.limit - pos - len(carry))
                chunk = f.read(want) if want > 0 else b""
                data = carry + chunk if carry else chunk
                if not data:
                    break
                at_limit = pos + len(data) >= r.limit or (want > 0 and not chunk)
                # Complete lines only, unless the readable limit is reached (then the tail is a line).
                cut = len(data) if at_limit else data.rfind(b"\n") + 1
                stopped = False
                if cut > 0:
                    batch, stopped = _lines_batch(r.rel, data[:cut] if cut < len(data) else data, pos, r.end)
                    if batch is not None:
                        yield batch
                if stopped or at_limit:
                    break
                pos, carry = pos + cut, data[cut:]


def _lower(options) -> dict:
    """Option names are case-insensitive; keep one lower-case spelling."""
    return {str(k).lower(): v for k, v in dict(options).items()}


def _positions(options) -> dict:
    raw = _lower(options).get("startingpositions")
    return json.loads(raw) if raw else {}


def _start_spans(lister: _Lister, files, starts: dict):
    """Catch-up rule: a type with a saved position skips older hours and starts that file at the position."""
    floors = {}
    for rel, pos in starts.items():
        hk = _hour_key(rel)
        if hk is not None:
            floors[hk[0]] = hk[1]
    spans = []
    for rel, hour_ts, size in files:
        t = rel.split("/")[0]
        if t in floors and hour_ts < floors[t]:
            continue
        spans.append((rel, int(starts.get(rel, 0)), hour_ts, size))
    return spans


def last_offset(checkpoint: str):
    """The newest source offset in a streaming checkpoint folder (planned, not necessarily committed), or None."""
    import pyarrow.fs as pafs

    fs, base = _fs(checkpoint)
    found = [i for i in fs.get_file_info(pafs.FileSelector(f"{base}/offsets", allow_not_found=True)) if i.base_name.isdigit()]
    if not found:
        return None
    with fs.open_input_stream(max(found, key=lambda i: int(i.base_name)).path) as f:
        text = f.read().decode().strip().split("\n")[-1]
    return json.loads(text) if text.startswith("{") else None


def progress(checkpoint: str) -> tuple:
    """(newest planned offset, newest planned batch, newest finished batch) of a checkpoint folder; -1 where there is none.

    A restarted ``availableNow`` query that first repeats an unfinished batch
    ends after it, so callers run it until this value stays.
    """
    import pyarrow.fs as pafs

    fs, base = _fs(checkpoint)
    last = [
        max((int(i.base_name) for i in fs.get_file_info(pafs.FileSelector(f"{base}/{kind}", allow_not_found=True)) if i.base_name.isdigit()), default=-1)
        for kind in ("offsets", "commits")
    ]
    return (last_offset(checkpoint), *last)


class BlockLogReader(DataSourceReader):
    def __init__(self, options):
        self.options = _lower(options)

    def partitions(self):
        lister = _Lister(self.options)
        files = lister.list()
        spans = []
        for rel, start, hour_ts, size in _start_spans(lister, files, _positions(self.options)):
            limit = lister.consumable(rel, size, hour_ts)
            if limit > start:
                spans.append((rel, start, limit))
        return lister.plan(spans) or [_Part([])]

    def read(self, partition):
        yield from _read_ranges(self.options.get("path") or self.options.get("root"), partition.ranges)


class BlockLogStreamReader(DataSourceStreamReader):
    """Offset: {"floor": {type: 'YYYYmmddHH'}, "files": {rel: bytes consumed}}.

    Every file of a type whose hour is before ``floor[type]`` is closed and
    fully consumed as of that offset; files at or after the floor are consumed
    up to ``files[rel]`` (0 when absent). Old hours therefore leave the offset,
    which stays small, and listing starts at the floor's date folder.
    """

    def __init__(self, options):
        self.options = _lower(options)
        self.lister = _Lister(self.options)
        self.max_bytes = int(self.options.get("maxbytespertrigger", 0)) or None
        self._latest = None

    @staticmethod
    def _floors(off):
        return {t: _dt.datetime.strptime(v, "%Y%m%d%H").replace(tzinfo=_dt.timezone.utc) for t, v in off.get("floor", {}).items()}

    def initialOffset(self):
        starts = _positions(self.options)
        floor = {}
        for rel in starts:
            hk = _hour_key(rel)
            if hk is not None:
                floor[hk[0]] = hk[1].strftime("%Y%m%d%H")
        return {"floor": floor, "files": {k: int(v) for k, v in starts.items()}}

    def latestOffset(self):
        # The next start is the newest offset of the checkpoint, so the byte
        # bound holds from the first trigger after a (re)start on, and the
        # new end cannot fall behind an offset that was planned before.
        if self._latest is None and self.options.get("checkpoint"):
            self._latest = last_offset(self.options["checkpoint"])
        known = self._latest is not None or bool(self.options.get("checkpoint"))
        prev = self._latest or self.initialOffset()
        pfloor = self._floors(prev)
        budget = self.max_bytes if known else None
        listing = self.lister.list(pfloor)
        pos = {}
        for rel, hour_ts, size in listing:
            done = int(prev["files"].get(rel, 0))
            limit = self.lister.consumable(rel, size, hour_ts) if size > done else done
            if budget is not None and limit - done > budget:
                limit = self.lister.line_end(rel, done, budget, limit) if budget > 0 else done
            pos[rel] = max(limit, done)
            if budget is not None:
                budget = max(0, budget - (pos[rel] - done))
        floor = {t: v for t, v in prev.get("floor", {}).items()}
        by_type = {}
        for rel, hour_ts, size in listing:
            by_type.setdefault(rel.split("/")[0], []).append((rel, hour_ts, size))
        for t, lst in by_type.items():
            f = None
            for rel, hour_ts, size in lst:
                if self.lister.closed(hour_ts) and pos[rel] >= size:
                    f = hour_ts + _dt.timedelta(hours=1)
                else:
                    break
            if f is not None:
                floor[t] = f.strftime("%Y%m%d%H")
        floors = self._floors({"floor": floor})
        files = {}
        for rel, hour_ts, size in listing:
            t = rel.split("/")[0]
            if (t not in floors or hour_ts >= floors[t]) and pos[rel] > 0:
                files[rel] = pos[rel]
        self._latest = {"floor": floor, "files": files}
        return self._latest

    def partitions(self, start, end):
        sfloors, efloors = self._floors(start), self._floors(end)
        sfiles, efiles = start.get("files", {}), end.get("files", {})
        spans = []
        for rel, hour_ts, size in self.lister.list(sfloors):
            t = rel.split("/")[0]
            s = int(sfiles.get(rel, 0))
            if t in efloors and hour_ts < efloors[t]:
                e = size  # closed and fully consumed as of end
            else:
                e = int(efiles.get(rel, 0))
            if e > s:
                spans.append((rel, s, e))
        return self.lister.plan(spans) or [_Part([])]

    def read(self, partition):
        yield from _read_ranges(self.lister.root, partition.ranges)

    def commit(self, end):
        pass


class BlockLogSource(DataSource):
    @classmethod
    def name(cls):
        return "blocklog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BlockLogReader(self.options)

    def streamReader(self, schema):
        return BlockLogStreamReader(self.options)


class _DatePart(InputPartition):
    def __init__(self, folders):
        self.folders = folders  # [(log_type, yyyymmdd)]


class BlockLogFilesReader(DataSourceReader):
    """S6 as a table: date folders are dealt to ~2 partitions per core; executors list the files."""

    def __init__(self, options):
        self.options = _lower(options)

    def partitions(self):
        import pyarrow.fs as pafs

        lister = _Lister(self.options)
        fs, base = _fs(lister.root)
        folders = []
        for t in lister.types:
            tdir = f"{base}/{t}/{HOURLY_DIR}"
            if fs.get_file_info(tdir).type != pafs.FileType.Directory:
                continue
            for d in fs.get_file_info(pafs.FileSelector(tdir)):
                if d.type == pafs.FileType.Directory and _DATE.match(d.base_name):
                    folders.append((t, d.base_name))
        n = max(1, min(len(folders), 2 * lister.parallelism))
        return [_DatePart(folders[i::n]) for i in range(n)] if folders else [_DatePart([])]

    def read(self, partition):
        import pyarrow.fs as pafs

        fs, base = _fs(self.options.get("path") or self.options.get("root"))
        for log_type, date_dir in partition.folders:
            d = f"{base}/{log_type}/{HOURLY_DIR}/{date_dir}"
            for f in fs.get_file_info(pafs.FileSelector(d)):
                rel = f"{log_type}/{HOURLY_DIR}/{date_dir}/{f.base_name}"
                if f.type == pafs.FileType.File and _hour_key(rel) is not None:
                    yield (rel, f.size)


class BlockLogFilesSource(DataSource):
    @classmethod
    def name(cls):
        return "blocklogfiles"

    def schema(self):
        return "file string, size bigint"

    def reader(self, schema):
        return BlockLogFilesReader(self.options)


def register(spark) -> None:
    """Register both sources.

    This module is pickled by value: Spark's streaming-source planner process
    does not receive the session's py-files, so the source classes travel
    inside the pickled data source instead of being imported there.
    """
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(BlockLogSource)
    spark.dataSource.register(BlockLogFilesSource)


def list_block_log(spark, root: str, types=None):
    """Hour files under root with their sizes: DataFrame(file, size); contents are not read."""
    r = spark.read.format("blocklogfiles").option("path", root).option("parallelism", spark.sparkContext.defaultParallelism)
    if types:
        r = r.option("types", ",".join(types))
    return r.load()


def read_block_log(spark, root: str, types=None, **options):
    """Batch read of all hour files under root: DataFrame(file, offset, value)."""
    r = spark.read.format("blocklog").option("path", root).option("parallelism", spark.sparkContext.defaultParallelism)
    if types:
        r = r.option("types", ",".join(types))
    for k, v in options.items():
        r = r.option(k, v if isinstance(v, str) else json.dumps(v) if isinstance(v, dict) else str(v))
    return r.load()


def stream_block_log(spark, root: str, types=None, **options):
    r = spark.readStream.format("blocklog").option("path", root).option("parallelism", spark.sparkContext.defaultParallelism)
    if types:
        r = r.option("types", ",".join(types))
    for k, v in options.items():
        r = r.option(k, v if isinstance(v, str) else json.dumps(v) if isinstance(v, dict) else str(v))
    return r.load()
