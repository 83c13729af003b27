from chainsift.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    filters = langid.learn(langid.training(docs))
    out = langid.predict(docs.withColumn("score", F.lit("clash")), filters).where(langid.held_out(F.col("doc_id")))
    n, right = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert right >= 0.97 * n


def test_undetermined_and_unknown(spark, docs_df):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 6)]
    filters = langid.learn(langid.training(docs_df(rows)))
    assert filters.langs == ["de", "en"]
    texts = [None, "", " 12 !", "the", "Und", "жж", "a", "the dog " * 5000]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs_df(list(enumerate(texts))), filters).collect()}
    assert [got[k] for k in range(3)] == [("und", 0.0)] * 3
    assert got[3][0] == "en" and got[4][0] == "de" and got[7][0] == "en"
    assert got[5][0] in ("en", "de") and got[5][1] == 0.0 and all(0 <= s <= 1 for _, s in got.values())


def test_nothing_to_learn_and_empty_table(spark, docs_df):
    filters = langid.learn(langid.training(docs_df([(1, "text", None), (2, None, "en")])))
    assert langid.predict(docs_df([(1, "text")]), filters).first().lang_pred == "und"
    assert langid.predict(docs_df([]), filters).count() == 0


def test_mask_holds_every_language_of_a_gram(spark, docs_df):
    rows = [(k, "shared words here", lang) for k, lang in enumerate(["a", "b", "c"] * 8)]
    filters = langid.learn(langid.training(docs_df(rows)))
    gram = langid.grams(["shared words here"])[0]
    assert (filters.masks(gram)[:, 0] == 0b111).all()


def exact(rows, texts):
    """Languages by exact n-gram sets, no filters and no correction."""
    from collections import Counter

    import zlib

    seen = {}
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            seen.setdefault(lang, Counter()).update(langid.grams([text])[0].tolist())
    total = {lang: sum(c.values()) for lang, c in seen.items()}
    most = {}
    for lang, c in seen.items():
        for g, n in c.items():
            most[g] = max(most.get(g, 0), n / total[lang])
    sets = {lang: {g for g, n in c.items() if n / total[lang] >= langid.SHARE * most[g]} for lang, c in seen.items()}
    out = []
    for text in texts:
        gram, _, has = langid.grams([text or ""])
        hits = {lang: sum(g in sets[lang] for g in gram.tolist()) for lang in sorted(sets)}
        best = max(sorted(hits), key=lambda x: (hits[x], -sorted(hits).index(x)))
        out.append((best, hits[best] / max(1, sum(hits.values()))) if has[0] else ("und", 0.0))
    return out


def test_slices_and_exact_sets_agree(spark, monkeypatch):
    """A filter of many slices, one slice and exact sets give the same languages, and nearly the same scores."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    want = {r[0]: w for r, w in zip(rows, exact(rows, [r[1] for r in rows]))}
    for slots in (langid.SLICE_SLOTS, 1 << 16):
        monkeypatch.setattr(langid, "SLICE_SLOTS", slots)
        filters = langid.learn(langid.training(docs))
        assert (filters.slices > 1) == (slots == 1 << 16) and filters.size <= slots
        out = langid.predict(docs.selectExpr("doc_id", "text", "lang as _row", "'x' as has"), filters).collect()
        assert len(out) == len(rows) and out[0]["has"] == "x"
        assert {r.doc_id: r.lang_pred for r in out} == {k: w[0] for k, w in want.items()}
        assert all(abs(r.score - want[r.doc_id][1]) < 0.05 for r in out)
