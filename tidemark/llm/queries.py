"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.byte_bpe import op8_byte_bpe
from tidemark.llm.common import ship
from tidemark.llm.imatch import op9_imatch
from tidemark.llm.importance import op2_importance_resampling
from tidemark.llm.kneser_ney import op3_kneser_ney
from tidemark.llm.line_dedup import OP7_SQL, op7_line_dedup
from tidemark.llm.packing import op10_best_fit_packing
from tidemark.llm.quality_rules import OP1_SQL, op1_quality_divergence
from tidemark.llm.simhash import op5_simhash_ball
from tidemark.llm.transcripts import op6_transcript_hmm
from tidemark.llm.url_filter import op4_url_markov

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    q.__name__: _shipped(q)
    for q in (
        op1_quality_divergence,
        op2_importance_resampling,
        op3_kneser_ney,
        op4_url_markov,
        op5_simhash_ball,
        op6_transcript_hmm,
        op7_line_dedup,
        op8_byte_bpe,
        op9_imatch,
        op10_best_fit_packing,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_divergence": OP1_SQL,
    "op7_line_dedup": OP7_SQL,
}
