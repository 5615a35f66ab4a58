"""What the operators of this subpackage share: reading tables, cutting lineage, hashing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import counted, drop, materialise, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mod_crc(column, divisor: int):
    """crc32 of the id as decimal text, modulo divisor."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(divisor)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def power_at_least(radix: int, n: int) -> int:
    return radix ** max(1, math.ceil(math.log(max(n, 2), radix) - 1e-9))


def clash_free(df: DataFrame, wanted: str) -> str:
    """A column name like wanted that df does not have."""
    names = {c.lower() for c in df.columns}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def keep_rows(docs: DataFrame, text_col: str, make_judge) -> DataFrame:
    """docs' rows whose text a judge keeps, all columns as they are. make_judge() is called once a task and gives a
    function from a list of texts to a list of booleans."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        judge = make_judge()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                yield part.filter(pa.array(judge(part.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
