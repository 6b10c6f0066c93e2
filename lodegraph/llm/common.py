"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written as materialize  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id's decimal digits, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Stretches of the batches whose texts hold ``most`` bytes together, or one row; what a task makes of them is bounded alike."""
    for batch in batches:
        start = held = 0
        for n, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if n > start and held + size > most:
                yield batch.slice(start, n - start)
                start, held = n, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
