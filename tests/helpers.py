"""Helpers of the tests: rows of log lines, hour files."""

import os


def lines_df(spark, values, file="node_fills_by_block/hourly/20240101/0"):
    rows, off = [], 0
    for v in values:
        rows.append((file, off, v))
        off += len(v.encode()) + 1
    return spark.createDataFrame(rows, "file string, offset bigint, value string")


def write_log(root, rel, text, mode="w"):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode + "b") as f:
        f.write(text.encode())
    return path
