"""Exact duplicates by a tree of sorted digest runs.

Each input partition makes one sorted run: a row per digest with its smallest identifier and its count. Runs then
meet in binomial rounds (recursive halving): in round r, runs whose numbers differ in digit r only exchange rows, each
keeping the digests whose home has its digit. A round is one shuffle of rows that are already summed, followed by a
multiway merge of sorted rows that keeps the smallest identifier of each digest. After the last round each digest is
one row at its home. A hot digest never weighs more than `radix` rows times the runs a node started with, so no group
meets in one task as a whole. Results go back along (run, digest), again at most one row per run for a digest.

A digest row carries SHA-256, byte length and a second checksum; rows only merge when all three agree.

Defined results:
    null text           counts as empty text, so all null and empty texts are one group
    null identifier     loses to any other identifier; a group of nulls keeps one row, with keep_id null
    repeated rows       exactly one row of a group is kept, whatever repeats
    empty table         empty result
    very long texts     hashed whole by the JVM
    further columns     ignored, whatever their names
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import clash_free, materialise, power_at_least, width

SPACE = r"[\x20\x09-\x0D]+"
KEY = ["sha", "n_bytes", "check"]


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _digest(text):
    t = normalised(text)
    return [F.sha2(t, 256).alias("sha"), F.octet_length(t).alias("n_bytes"), F.xxhash64(t).alias("check")]


def _digit(n, place: int, radix: int):
    return F.floor(n / F.lit(radix**place)).cast("int") % F.lit(radix)


def merge_runs(runs: DataFrame, radix: int, nodes: int) -> DataFrame:
    """runs: origin, KEY, best (struct), size. One row per digest: KEY, best, size."""
    home = F.conv(F.substring("sha", 1, 6), 16, 10).cast("int") % F.lit(nodes)
    level = runs.withColumn("home", home).withColumn("node", F.col("origin") % F.lit(nodes))
    place = 0
    while radix**place < nodes:
        moved = F.col("node") + (_digit(F.col("home"), place, radix) - _digit(F.col("node"), place, radix)) * F.lit(radix**place)
        same = Window.partitionBy("node", *KEY)
        level = (
            level.withColumn("node", moved.cast("int"))
            .repartition(nodes, "node")
            .sortWithinPartitions("node", *KEY, "best")
            .withColumn("rank", F.row_number().over(same.orderBy("best")))
            .withColumn("size", F.sum("size").over(same))
            .where("rank = 1")
            .drop("rank")
        )
        place += 1
    return level.select(*KEY, "best", "size")


def decided(docs: DataFrame, id_col: str, text_col: str, radix: int, row=None) -> DataFrame:
    """One row per input row: me and best (structs of none, id, row), size, sha. row numbers the rows of docs."""
    rows = materialise(
        docs.select(
            F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), (F.monotonically_increasing_id() if row is None else row).alias("row")).alias("me"),
            F.spark_partition_id().alias("origin"),
            *_digest(F.col(text_col)),
        )
    )
    runs = rows.groupBy("origin", *KEY).agg(F.min("me").alias("best"), F.count("*").alias("size"))
    merged = merge_runs(runs, radix, power_at_least(radix, width(docs.sparkSession)))
    back = runs.select("origin", *KEY).join(merged, KEY)
    return rows.join(back, ["origin", *KEY]).select("me", "best", "size", "sha")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = 4) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    return decided(docs, id_col, text_col, radix).select(
        F.col("me.id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (F.col("me.row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = 4) -> DataFrame:
    """The rows of docs that stay, with docs' columns. Rows that repeat both id and text stay once.

    docs are written once with a number for each row; the rows that stay are then found by it, so that a hot text or a
    row that repeats meets in no task."""
    number = clash_free(docs, "row")
    numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()))
    kept = decided(numbered, id_col, text_col, radix, F.col(number)).where("me.row = best.row").select(F.col("me.row").alias(number))
    return numbered.join(kept, number, "left_semi").select(*docs.columns)
