"""Property test of the block-log splitting: any split size yields exactly the naive line split."""

import os
import tempfile

from hypothesis import given, settings
from hypothesis import strategies as st

from chainsift.sources.blocklog import _Lister, _read_ranges

REL = "node_fills_by_block/hourly/20240101/5"
ROOT = tempfile.mkdtemp(prefix="chainsift-props-", dir="/tmp")

line = st.text(alphabet=st.sampled_from(list("ab{}\" é€\r")), max_size=12)


def naive(data: bytes, with_tail: bool):
    out, pos = [], 0
    parts = data.split(b"\n")
    tail = parts.pop()
    for p in parts:
        out.append((pos, p.decode("utf-8", "replace")))
        pos += len(p) + 1
    if with_tail and tail:
        out.append((pos, tail.decode("utf-8", "replace")))
    return out


@settings(max_examples=300, deadline=None)
@given(lines=st.lists(line, max_size=30), tail=line, split=st.integers(1, 64), start_line=st.integers(0, 5), closed=st.booleans())
def test_ranges_cover_each_line_once(lines, tail, split, start_line, closed):
    data = "".join(x + "\n" for x in lines).encode() + tail.encode()
    path = os.path.join(ROOT, REL)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    lister = _Lister({"path": ROOT, "splitBytes": str(split), "openCostBytes": "1"})
    limit = len(data) if closed else data.rfind(b"\n") + 1
    start = sum(len(x.encode()) + 1 for x in lines[: min(start_line, len(lines))])
    start = min(start, limit)
    parts = lister.plan([(REL, start, limit)]) if limit > start else []
    got = []
    for p in parts:
        for rb in _read_ranges(ROOT, p.ranges):
            got += list(zip(rb.column("offset").to_pylist(), rb.column("value").to_pylist()))
    want = [(o, v) for o, v in naive(data[:limit], closed) if o >= start]
    assert got == want
