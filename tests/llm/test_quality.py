import numpy as np
from pyspark.sql import functions as F

from chainsift.llm import quality as Q


def test_labels_of_the_test_table(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.classify(docs.select("doc_id", "text"), Q.fit(docs, labels)).join(labels, "doc_id")
    n = {(r.bad, r.kept): r["count"] for r in out.withColumn("bad", (F.col("quality") == 0) | (F.col("toxic") == 1)).groupBy("bad", "kept").count().collect()}
    assert n.get((False, False), 0) <= 0.01 * n[False, True]
    assert n[True, False] >= 0.9 * (n[True, False] + n.get((True, True), 0))


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(1)
    bad = rng.random(20_000) < 0.1
    kind = rng.integers(0, 3, 20_000)
    vote = np.stack([np.where(rng.random(20_000) < np.where(bad & (kind == k), 0.9, 0.005), Q.REJECT, Q.KEEP) for k in range(3)], axis=1)
    u, n = np.unique(vote, axis=0, return_counts=True)
    prior, rates = Q.estimate(u, n.astype(float))
    assert abs(prior[0] - 0.9) < 0.02
    assert all(abs(rates[k + 1, k] - 0.9) < 0.12 and rates[0, k] < 0.02 for k in range(3))


def test_junk_empty_long_and_clashing_columns(spark, docs_df, prose):
    good = [prose(60) + "." for _ in range(60)]
    junk = ["LOUD!! WORDS!! HERE!! " * 10, "a*** b$$$ c%%% " * 10, "x | y | z | w | v | u | " * 5, "same " * 50]
    docs = docs_df(list(enumerate(good + junk * 5 + ["", None, "  ", prose(50_000)]))).withColumnRenamed("n", "score")
    got = {r.doc_id: r for r in Q.classify(docs, Q.fit(docs)).collect()}
    assert all(got[k].kept for k in range(60))
    assert not any(got[60 + k].kept for k in range(20))
    assert not any(got[80 + k].kept for k in range(3)) and got[83].kept
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "score", "weak_reject", "kept"}


def test_insults_are_learnt(spark, docs_df, prose):
    rows = [(k, prose(30) + (" Dolt, " if k % 10 == 0 else " ") + prose(30)) for k in range(300)] + [(None, "x")]
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(200)] + [(None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    docs = docs_df(rows)
    model = Q.fit(docs, labels)
    got = {r.doc_id: r.kept for r in Q.classify(docs, model).collect()}
    assert len(model.insults) >= 1
    assert not any(got[k] for k in range(0, 300, 10)) and all(got[k] for k in range(300) if k % 10)


def test_empty_table(spark, docs_df):
    none = docs_df([])
    assert Q.classify(none, Q.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
