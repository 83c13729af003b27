"""Documents to training tokens: five stages, each reading what the one before it wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. SQL cannot express the stages, so
ORACLE_SQL is None and tests compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainsift.llm import decontaminate, ngramjoin, prefixbpe, quality, suffixdedup
from chainsift.llm.common import stored, table
from chainsift.llm.queries import vocabulary
from chainsift.session import configure


#: Words of a passage that stage 3 cuts out wherever it repeats: all passages of over 50 words.
PASSAGE_WORDS = 51


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects: junk and insults."""
    configure(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where("kept").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    configure(spark)
    return ngramjoin.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that occur anywhere else (over 50 words, or op7's 400 bytes); n_chars counts what is left."""
    configure(spark)
    return suffixdedup.cut(docs, PASSAGE_WORDS).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    configure(spark)
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text again."""
    configure(spark)
    out = prefixbpe.encode_decode(docs, vocabulary())
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
