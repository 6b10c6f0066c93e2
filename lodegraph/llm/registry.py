"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .bpe import op2_bpe
from .simhash import op6_simhash
from .spans import op8_spans
from .toxicity import op3_toxicity
from .decontaminate import op9_decontaminate
from .htmltext import op5_html
from .pii import op10_pii
from .ppm import op7_ppm
from .secrets import op4_secrets
from .winnow import op1_winnowing

Query = Callable[[SparkSession, str], DataFrame]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    "op1_winnowing": _shipped(op1_winnowing),
    "op2_bpe": _shipped(op2_bpe),
    "op6_simhash": _shipped(op6_simhash),
    "op3_toxicity": _shipped(op3_toxicity),
    "op4_secrets": _shipped(op4_secrets),
    "op5_html": _shipped(op5_html),
    "op7_ppm": _shipped(op7_ppm),
    "op8_spans": _shipped(op8_spans),
    "op9_decontaminate": _shipped(op9_decontaminate),
    "op10_pii": _shipped(op10_pii),
    "pipeline": _shipped(pipeline),
}
SQL: dict[str, str] = {}
