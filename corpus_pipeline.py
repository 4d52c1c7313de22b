"""The corpus pipeline: language, near duplicates, repeated passages, benchmark passages, tokens.

Each stage takes all documents that the one before kept and returns the columns of documents; the last returns digests
of the tokens. run() writes every stage's result in the shared folder and reads it again.

In every stage columns besides those of documents are ignored, whatever their names, and repeated rows are rows of their
own. A null lang teaches nothing; source and n_chars aren't looked at. Rows of one doc_id are one document as to near
duplicates, and don't cut passages from each other. A null doc_id is never held out, never a near duplicate's other, and
larger than all others as to passages. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm import bpe, decontaminate, jaccard, language, substrings
from quartzite.llm.common import table, written
from quartzite.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of text that a task of the passages' stage holds: less than op2's own, as executors here also hold what earlier stages left.
CHUNK = 4_000_000


def _rested(spark: SparkSession) -> None:
    """Has executors collect garbage, so that they give back the heap that the stage before needed: Python workers of the next one have to live beside it."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars being those of the text as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the text has letters and some learned language claims it; learned from the documents that aren't held out.

    Null and empty texts and texts without letters go; without a labelled document nothing is learned, and all go.
    """
    _rested(spark)
    docs = docs.select(*COLUMNS)
    model = language.fit(docs.where(~language.held_out()))
    found = language.predict(docs, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") > 0)).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that near-duplicate links join, the one of the smallest id; a link is four fifths of the five-word shingles or more. Texts without words stay."""
    _rested(spark)
    return jaccard.one_of_each(docs, percent=80, size=5).select(*COLUMNS)


def cut_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that a document of a smaller id has; no document goes."""
    _rested(spark)
    return _sized(substrings.repeated_spans(docs.select(*COLUMNS), cut=True, chunk_bytes=CHUNK))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ten words that a benchmark item has; no document goes."""
    _rested(spark)
    found = decontaminate.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return _sized(decontaminate.without_hits(found))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's tokens and of what they decode to."""
    _rested(spark)
    return bpe.encode_decode(docs, vocabulary())


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each),
    ("repeated_passages", cut_repeated),
    ("benchmark", cut_benchmark),
    ("tokens", encode),
]

#: Kernel machines, suffix arrays and byte-pair merges aren't SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
