"""``storefeed`` stream source: which batches of an event store were committed, and since when.

Rows: ``(run_id, event, after_batch, upto_batch)``, one per stream (run and
event type) that has new batches; the rows of a micro-batch name each
committed batch once. The offset is ``{"<run>-<event>": last batch}``, so it
holds no commit names: folding the commit log, compaction and retention leave
it valid. The events themselves are read by Spark (``streaming.feed``); this
source only reads the commit log, whose length ``fold_commits`` bounds.

Options
  path                 the event store
  startingAt           ``earliest`` (default) or ``latest``: batches committed before the first start are skipped
  maxBatchesPerTrigger largest number of batches of each stream in a micro-batch (needs ``checkpoint``)
  checkpoint           the query's checkpoint folder, where the last planned offset is read after a restart
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from chainsift.sources.blocklog import _fs, _lower, last_offset

COMMITS = "_commits"
SCHEMA = "run_id string, event string, after_batch int, upto_batch int"


def read_commits(path: str) -> dict[str, dict]:
    """Commit files by name, without those that a later one has folded in.

    A fold that runs meanwhile publishes its file before it deletes those it
    replaces, so a file that is gone when it is opened means: list again. A
    listing taken while a fold runs may hold neither the fold's file nor those
    it deleted, so a second one must show no other fold and miss no file.
    """
    import pyarrow.fs as pafs

    fs, base = _fs(path)

    def listed() -> dict[str, str]:
        infos = fs.get_file_info(pafs.FileSelector(f"{base}/{COMMITS}", allow_not_found=True))
        return {i.base_name[: -len(".json")]: i.path for i in infos if i.base_name.endswith(".json")}

    while True:
        found, gone = {}, False
        for name, file in listed().items():
            try:
                with fs.open_input_stream(file) as f:
                    found[name] = json.loads(f.read())
            except FileNotFoundError:
                gone = True
        now = listed()
        if not gone and found.keys() <= now.keys() and not any(n.startswith("fold-") for n in now.keys() - found.keys()):
            folded = {n for c in found.values() for n in c.get("folds", ())}
            return {n: c for n, c in found.items() if n not in folded}


def stream_batch(name: str) -> tuple[str, int] | None:
    """(stream, batch) of a stream batch's name ``<run>-<event>-<ten digits>``, None for other names."""
    stream, dash, digits = name[:-11], name[-11:-10], name[-10:]
    return (stream, int(digits)) if stream and dash == "-" and digits.isdigit() else None


def heads(commits: dict[str, dict]) -> dict[str, int]:
    """The last committed batch of each stream."""
    out: dict[str, int] = {}
    for name, c in commits.items():
        upto = dict(c["meta"].get("upto", {}))
        own = stream_batch(name) if c["meta"].get("stream") else None
        if own:
            upto[own[0]] = own[1]
        for stream, batch in upto.items():
            out[stream] = max(batch, out.get(stream, -1))
    return out


class _Ranges(InputPartition):
    def __init__(self, ranges):
        self.ranges = ranges


class StoreFeedReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options = _lower(options)
        self.path = self.options["path"]
        self.most = int(self.options.get("maxbatchespertrigger", 0)) or None
        self.checkpoint = self.options.get("checkpoint")
        if self.most and not self.checkpoint:
            raise ValueError("maxBatchesPerTrigger needs the checkpoint option")
        self.last = None

    def initialOffset(self):
        return heads(read_commits(self.path)) if self.options.get("startingat") == "latest" else {}

    def latestOffset(self):
        now = heads(read_commits(self.path))
        if self.most:
            if self.last is None:
                planned = last_offset(self.checkpoint)
                self.last = self.initialOffset() if planned is None else planned
            now = {s: min(b, self.last.get(s, -1) + self.most) for s, b in now.items()}
            self.last = now
        return now

    def partitions(self, start, end):
        return [_Ranges([(s, start.get(s, -1), b) for s, b in sorted(end.items()) if b > start.get(s, -1)])]

    def read(self, partition):
        for stream, after, upto in partition.ranges:
            yield (*stream.rsplit("-", 1), after, upto)

    def commit(self, end):
        pass


class StoreFeedSource(DataSource):
    @classmethod
    def name(cls):
        return "storefeed"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return StoreFeedReader(self.options)


def register(spark) -> None:
    """Register the source; it is pickled by value, like the block log's (see there)."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(StoreFeedSource)
