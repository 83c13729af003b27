"""Property test: the strict line parse accepts exactly the texts a strict JSON decoder accepts."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainsift.functions.jsonv import strict_parse_json

scalar = st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.text(alphabet='ab"\\é /', max_size=5)
value = st.recursive(
    scalar, lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("abc", max_size=3), c, max_size=3), max_leaves=8
)


def damage(v, how, n):
    s = json.dumps(v, ensure_ascii=False)
    return {
        "none": s,
        "space": f"  {s} \t",
        "trail": s + " x",
        "twice": s + s,
        "trunc": s[: max(0, len(s) - 1 - n % 3)],
        "comma": s + ",",
        "quote": s.replace('"', "'"),
    }[how]


text = st.builds(damage, value, st.sampled_from(["none", "space", "trail", "twice", "trunc", "comma", "quote"]), st.integers(0, 9))


def python_accepts(s: str) -> bool:
    def reject(_):
        raise ValueError("constant")

    try:
        json.loads(s, parse_constant=reject)
        return True
    except ValueError:
        return False


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(texts=st.lists(text, min_size=40, max_size=80))
def test_strict_parse_matches_strict_json(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    got = {r["i"]: r["ok"] for r in df.select("i", strict_parse_json("value").isNotNull().alias("ok")).collect()}
    bad = [(t, got[i]) for i, t in enumerate(texts) if got[i] != python_accepts(t)]
    assert not bad, bad[:5]
