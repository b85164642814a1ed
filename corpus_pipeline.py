"""Corpus pipeline: quality classifier, language ID, near-duplicates, mixing, packing. Each stage works on all its predecessor kept.

Every stage but the last returns the columns of documents. A row whose doc_id is null passes the filters by its text and is kept
apart by them: it is no copy of another row to the near-duplicate stage, which drops rows by doc_id and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import langid, mixing, packing, quality, simhash
from tidewright.llm.common import scratch, table
from tidewright.llm.queries import quality_weights, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps, with the labels as target: weighed by their mean n-gram, so that length does not decide."""
    return quality.keep(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), temperature=0.005, mean=True)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages the filters know: `und` goes, and so does a text of which no filter has anything (score 0).
    One too short for an n-gram has nothing to look up, and stays if it has a letter."""
    filters = langid.train(docs)
    found = langid.predict(docs, filters, *COLUMNS)
    return found.where((F.col("lang_pred") != "und") & ((F.col("score") > 0) | (F.octet_length("text") < langid.N))).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; of rows that repeat it, one."""
    marked = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"))
    found = simhash.near_duplicates(marked, carried=("_text",))
    rest = found.where("doc_id <> component_id").select("doc_id", "_text").distinct()
    return marked.join(rest, ["doc_id", "_text"], "left_anti").select(*COLUMNS).dropDuplicates(["doc_id", "text"])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them."""
    return mixing.apply_mix(docs.select(*COLUMNS), quality_weights(table(spark, sf_dir, "labels")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences: one row each."""
    return packing.pack_documents(docs, tokenizer(), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: The models have no SQL form; tests hold each stage's operator against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            at = scratch(spark, f"stage{i}")
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
    return docs
