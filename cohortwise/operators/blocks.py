"""Rows packed into blocks that tasks read as matrices, for fits that pass over them many times."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.seeded import uniform
from cohortwise.operators.ordering import ordered_index
from cohortwise.session import materialize

BLOCK_ROWS = 50_000
BLOCK_BYTES = 32_000_000
KINDS = {"x": np.float64, "w": np.float64, "y": np.int32, "held": np.bool_, "key": np.int64, "fold": np.int32}


def rows_per_block(width: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))


def distinct_rows(df: DataFrame, features: str, label: str | None = None, weight: str | None = None) -> DataFrame:
    """(x, y, w): every different row once, with the summed weight of its copies. A hot row is summed before it moves.

    Rows without features, without a label where one is named, or without a positive weight take no part.
    """
    x = F.col(features) if df.schema[features].dataType.typeName() == "array" else vector_to_array(features)
    chosen = df.filter(F.col(features).isNotNull()).select(
        x.cast("array<double>").alias("x"),
        (F.col(label).cast("int") if label else F.lit(0)).alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    )
    return chosen.filter(F.col("y").isNotNull() & (F.col("w") > 0)).groupBy("x", "y").agg(F.sum("w").alias("w"))


def _settled(blocks: DataFrame) -> DataFrame:
    """Written blocks. A single one is declared a single partition, so that sums over it need no exchange."""
    return blocks if blocks.count() > 1 else blocks.coalesce(1)


def seeded_blocks(rows: DataFrame, seed: int, share: float, size: int | None = None) -> DataFrame:
    """``rows`` (x, y, w; all different) in blocks of equal size, written: (block, d, x, y, w, held), matrices as bytes.

    A row's block, its place there, and whether it is held out (``share`` of the rows) follow from a hash of its content, so
    they do not depend on partitioning. ``size`` rows make a block, by default what fits into 32 MB.
    """
    keyed = rows.withColumn("_order", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("x").cast("string"), F.col("y").cast("string"))))
    placed = materialize(ordered_index(keyed, ["_order"], "_pos"), "placed")
    known = placed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    count = max(1, math.ceil(known["n"] / (size or rows_per_block(known["d"] or 1))))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_pos")
        x = np.stack(group["x"].to_numpy()).astype(float)
        return pd.DataFrame({
            "block": [int(group["block"].iloc[0])], "d": [x.shape[1]], "x": [x.tobytes()], "y": [group["y"].to_numpy(np.int32).tobytes()],
            "w": [group["w"].to_numpy(float).tobytes()], "held": [group["held"].to_numpy(bool).tobytes()],
        })

    held = (uniform(f"{seed}held", "_order") < share).alias("held")
    cut = placed.select((F.col("_pos") % count).cast("int").alias("block"), "_pos", "x", "y", "w", held)
    packed = cut.groupBy("block").applyInPandas(pack, "block int, d int, x binary, y binary, w binary, held binary")
    return _settled(materialize(packed, "blocks"))


def plain_blocks(rows: DataFrame, others: list[str]) -> DataFrame:
    """``rows`` (x and ``others``) as they lie, written: (d, x, others), matrices as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy()).astype(float)
                for at in range(0, len(x), step := rows_per_block(x.shape[1])):
                    part = slice(at, at + step)
                    yield pd.DataFrame({"d": [x.shape[1]], "x": [x[part].tobytes()]} | {c: [batch[c].to_numpy(KINDS[c])[part].tobytes()] for c in others})

    return _settled(materialize(rows.mapInPandas(pack, "d int, x binary, " + ", ".join(f"{c} binary" for c in others)), "blocks"))


def hashed_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (x, w) as they lie, written: (d, x, w, key), matrices as bytes; ``key`` is a hash of the row's content."""
    return plain_blocks(rows.select("x", "w", F.xxhash64("x").alias("key")), ["w", "key"])


def unpacked(batch: pd.DataFrame) -> Iterator[dict]:
    """The blocks of a batch with their matrices."""
    for row in batch.to_dict("records"):
        block = {c: np.frombuffer(row[c], kind) for c, kind in KINDS.items() if c in row}
        block["x"] = block["x"].reshape(-1, row["d"])
        yield block | {"block": row.get("block", 0)}
