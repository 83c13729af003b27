import corpus_pipeline as C
from chainsift.llm import common

SF = "/root/testdata/sf0.01"


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 3), (500, 300)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 150: 100, 200: 100, 300: 300, 500: 300}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        before = docs
        docs = common.stored(stage(spark, docs, SF), name)
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert seen[name] <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
    # Clean documents stay: of those labelled good, only copies and leaks go after the classifier.
    good = {r.doc_id for r in common.table(spark, SF, "labels").where("quality = 1 and toxic = 0").collect()}
    assert len(good & seen["quality_classifier"]) >= 0.99 * len(good)
    assert seen["suffix_array_dedup"] == seen["ngram_jaccard_join"] and seen["bpe_encoding"] == seen["benchmark_decontamination"]
    assert docs.where("round_trip").count() == docs.count() > 0
    assert len(seen["bpe_encoding"]) < len(seen["ngram_jaccard_join"]) < len(seen["quality_classifier"])


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "words of a text without id", "en", "s", 3), (2, "", "en", "s", 0), (3, "clean words follow here", "en", "s", 23)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for _, stage in C.STAGES:
            stage(spark, given, SF).collect()
