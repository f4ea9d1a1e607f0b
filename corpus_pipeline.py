"""Corpus pipeline: documents to packed training sequences, in five stages.

``STAGES`` are applied in order; each stage's result is written as Parquet and
reread as the next one's documents.  A stage may leave tables behind that its
result still reads; the next stage, whose input is then stored, removes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm import minhash_dedup, mixing, packing, quality_rules, suffix_dedup
from wayfarer.llm.tables import drop, left, store
from wayfarer.session import read_table

_passed: list[str] = []


def _stage(work):
    """A stage that first removes what the stage before it has left."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, *[p for p in _passed if p in left()])
        _passed.clear()
        there = set(left())
        result = work(spark, docs, sf_dir)
        _passed.extend(p for p in left() if p not in there)
        return result

    run_stage.__doc__, run_stage.__name__ = work.__doc__, work.__name__
    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_filter(docs)


@_stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more), that of the smallest id."""
    return minhash_dedup.drop_near_duplicates(docs, percent=80)


@_stage
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat; ``n_chars`` follows the text."""
    cut = suffix_dedup.remove_repeats(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in shuffled order."""
    return mixing.mix_sources(docs).select(*docs.columns)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences: sequence_id, n_tokens, doc_ids in order, pieces with their ids."""
    packed = packing.pack_sequences(docs)
    return packed.select("sequence_id", "n_tokens", F.transform("pieces", lambda p: p["doc_id"]).alias("doc_ids"),
                         "pieces")


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Covariance fits, components, byte-level matches and tokenizers have no SQL
#: form; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each over the stored output of the one before."""
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs, path = store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
