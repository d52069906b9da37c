"""From raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of ``docs``:

1. quality classifier: importance resampling against the labelled good documents; the rest goes
2. quality rules: base rules and distance to the language references; what fails goes
3. line dedup: a line that several documents hold stays in the first of them; ``n_chars`` follows
4. SimHash near-dedup at Jaccard similarity 0.8 or more of five-word shingle sets: the smallest ``doc_id`` of each group stays
5. best-fit packing of what is left

An empty table goes through all stages and gives an empty result. A null text is empty: it has no words, so the rules
reject it, as they do an empty one. A null id is one document like any other, before all of them; rows that repeat an id are each
judged by their own text, and stay or go together as near-duplicates of others. Ties go to the smallest id. Extra columns
come through all stages but the last untouched, whatever their names; names starting with ``__td_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, ship
from tidemark.llm.importance import quality_filter
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.packing import best_fit_packing
from tidemark.llm.quality_rules import rules_filter
from tidemark.llm.similar import keep_first


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules_filter(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the operator's own counts aren't wanted, and columns of their names are the documents'
    clash = [c for c in docs.columns if c in ("n_lines", "n_dropped")]
    cleaned = line_dedup(docs.withColumnsRenamed({c: f"__td_own_{c}" for c in clash})).drop("n_lines", "n_dropped")
    cleaned = cleaned.withColumnsRenamed({f"__td_own_{c}": c for c in clash})
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_first(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return best_fit_packing(docs)


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: The classifier, the near-duplicates' links and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
