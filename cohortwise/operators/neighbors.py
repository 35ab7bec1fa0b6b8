"""Exact nearest neighbours between two vector tables, and what is built on them.

Two exact ways, chosen by the measured size of the searched side:

* It fits a fixed byte bound: every task searches the whole of it, part by part, and hands
  on k rows per query.
* It does not: both sides are cut into cells around pivots. A first look into the nearest cell gives
  every query k true distances, and the largest bounds how far to look: by the triangle inequality
  a query visits only cells that can hold something nearer. Both sides are packed into blocks of bounded size in the
  order of their cells; a task compares one block of queries with one of searched rows, cell by cell, and
  only pairs of blocks with a cell to visit meet. So a side moves once per block of the other, not once per cell or tile.

Distances are taken for a few hundred queries and a few thousand rows at a time, whatever the size of the sides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.seeded import hash_key
from cohortwise.functions.vectors import as_double
from cohortwise.operators.blocks import rows_per_block
from cohortwise.session import materialize

BROADCAST_BYTES = 64 << 20
TILE_ROWS = 4096
MAX_PIVOTS = 2048
DECIMALS = 6  # distances equal after rounding are ties, broken by the smaller id
PART_QUERIES, PART_ROWS = 512, 2048  # distances held at once
PART_BYTES = 8 << 20  # differences, or distances to pivots, held at once
LEAST_BLOCKS = 6  # per side, so that a small table still gives work to many tasks
_PAIR = "query_id bigint, neighbor_id bigint, distance double"


def knn_join(
    queries: DataFrame,
    searched: DataFrame,
    key: str,
    vec: str,
    k: int,
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    pivots: int | None = None,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(query_id, neighbor_id, distance, rank): the k nearest rows of ``searched`` per query.

    A null vector has no neighbours and is nobody's neighbour.
    """
    q = queries.filter(F.col(vec).isNotNull()).select(F.col(key).cast("bigint").alias("id"), as_double(vec).alias("v"))
    s = searched.filter(F.col(vec).isNotNull()).select(F.col(key).cast("bigint").alias("id"), as_double(vec).alias("v"))
    size = s.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size["n"]:
        return queries.sparkSession.createDataFrame([], _PAIR + ", rank int")
    if size["n"] * size["d"] * 8 <= broadcast_bytes:
        return _search_whole(q, s, k, exclude_self)
    return _search_cells(q, s, k, exclude_self, size["n"], pivots, tile_rows)


def _block_rows(n: int, width: int, least: int) -> int:
    """Rows of a block: what a task can hold, fewer where the table would give less than a few blocks."""
    return max(1, min(rows_per_block(width), max(least, -(-n // LEAST_BLOCKS))))


def _part_rows(width: int) -> int:
    """Rows of ``width`` numbers that are held at once."""
    return max(1, PART_BYTES // (8 * max(1, width)))


def _gaps(a, b, first, second):
    """Euclidean distances of the row pairs (first[i], second[i]) from their differences."""
    out = np.empty(len(first))
    step = _part_rows(a.shape[1])
    for at in range(0, len(first), step):
        part = slice(at, at + step)
        out[part] = np.sqrt(((b[second[part]] - a[first[part]]) ** 2).sum(axis=1))
    return out


def _home(rows, to_pivots, pivots, usable=None):
    """The nearest (usable) pivot of every row, and how far it is."""
    cell, least = np.empty(len(rows), np.int32), np.empty(len(rows))
    for at in range(0, len(rows), step := _part_rows(pivots)):
        part = slice(at, at + step)
        gaps = to_pivots(rows[part])
        if usable is not None:
            gaps[:, ~usable] = np.inf
        cell[part], least[part] = gaps.argmin(axis=1), gaps.min(axis=1)
    return cell, least


class _Nearest:
    """The k nearest rows seen so far by every query of a block, ties by id. Rows come in any number of parts.

    The product form picks the candidates with a safety margin, then their distances are
    computed directly from the differences. Nothing farther than ``reach`` is looked for.
    """

    def __init__(self, ids, points, k, reach=None):
        self.ids, self.points, self.k = ids, points, k
        self.squares = (points * points).sum(axis=1)
        self.reach = np.full(len(ids), np.inf) if reach is None else reach
        self.gap = np.full((len(ids), k), np.inf)
        self.row = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids, rows, exclude_self=False, which=None):
        which = np.arange(len(self.ids)) if which is None else which
        for start in range(0, len(rows), PART_ROWS):
            part, squares = rows[start : start + PART_ROWS], (rows[start : start + PART_ROWS] ** 2).sum(axis=1)
            wide = np.column_stack([part, squares]).T
            for at in range(0, len(which), PART_QUERIES):
                self._compare(which[at : at + PART_QUERIES], ids[start : start + PART_ROWS], part, wide, squares.max(), exclude_self)

    def _compare(self, mine, ids, rows, wide, longest, exclude_self):
        points, lengths = self.points[mine], self.squares[mine]
        # The squared distance less the query's own square, in one product.
        rough = np.column_stack([-2.0 * points, np.ones(len(mine))]) @ wide
        if exclude_self:
            rough[self.ids[mine][:, None] == ids[None, :]] = np.nan
        limit = np.minimum(self.gap[mine, -1], self.reach[mine]) ** 2
        unknown = np.isinf(limit)
        if rough.shape[1] > self.k and unknown.any():
            limit[unknown] = np.maximum(np.partition(rough[unknown], self.k - 1, axis=1)[:, self.k - 1] + lengths[unknown], 0.0)
            limit[np.isnan(limit)] = np.inf
        slack = 1e-9 * (lengths + longest) + 4.0 * 10.0**-DECIMALS * np.sqrt(np.minimum(limit, 1e300)) + 1e-11
        query, row = np.divmod(np.flatnonzero(rough <= (limit + slack - lengths)[:, None]), len(rows))
        if not len(query):
            return
        exact = np.round(_gaps(points, rows, query, row), DECIMALS)
        query = np.concatenate([np.repeat(np.arange(len(mine)), self.k), query])
        gap = np.concatenate([self.gap[mine].ravel(), exact])
        seen = np.concatenate([self.row[mine].ravel(), ids[row]])
        order = np.lexsort((seen, gap, query))
        top = order[np.searchsorted(query[order], np.arange(len(mine)))[:, None] + np.arange(self.k)]
        self.gap[mine], self.row[mine] = gap[top], seen[top]

    def found(self) -> pd.DataFrame:
        query, place = np.nonzero(np.isfinite(self.gap))
        return pd.DataFrame({
            "query_id": self.ids[query], "neighbor_id": self.row[query, place], "distance": self.gap[query, place],
            "rank": (place + 1).astype(np.int32),
        })


def _search_whole(q: DataFrame, s: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The searched side is below the byte bound: ship it once to every executor."""
    held = s.toPandas()
    whole = q.sparkSession.sparkContext.broadcast((held["id"].to_numpy(), np.stack(held["v"].to_numpy())))

    def search(batches):
        ids, rows = whole.value
        for batch in batches:
            if len(batch):
                nearest = _Nearest(batch["id"].to_numpy(), np.stack(batch["v"].to_numpy()), k)
                nearest.see(ids, rows, exclude_self)
                yield nearest.found()

    return q.mapInPandas(search, _PAIR + ", rank int")


def _search_cells(
    q: DataFrame, s: DataFrame, k: int, exclude_self: bool, rows: int, pivots: int | None, tile_rows: int
) -> DataFrame:
    """Search by cells on distinct vectors.

    Of equal searched vectors only the smallest ids can appear in a result, and equal queries
    share one result, so a group of copies costs no more than a few rows. A query that must
    not find itself asks for one neighbour more and leaves itself out.
    """
    asked = k + int(exclude_self)
    same = Window.partitionBy("v").orderBy("id")
    few = s.withColumn("_copy", F.row_number().over(same)).filter(F.col("_copy") <= asked).drop("_copy")
    searched = materialize(few, "searched")
    owners = materialize(q.groupBy("v").agg(F.min("id").alias("owner")), "owners")
    found = _cell_pairs(owners.select(F.col("owner").alias("id"), "v"), searched, asked, rows, pivots, tile_rows)
    spread = q.join(owners, "v").select("id", "owner").join(found.withColumnRenamed("query_id", "owner"), "owner")
    if exclude_self:
        spread = spread.filter(F.col("id") != F.col("neighbor_id"))
    nearest = Window.partitionBy("id").orderBy("distance", "neighbor_id")
    return (
        spread.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
        .select(F.col("id").alias("query_id"), "neighbor_id", "distance", "rank")
    )


def _cell_pairs(
    q: DataFrame, s: DataFrame, k: int, rows: int, pivots: int | None, tile_rows: int
) -> DataFrame:
    pivots = max(k + 1, pivots or min(MAX_PIVOTS, max(32, rows // tile_rows)))
    chosen = s.withColumn("_h", hash_key("pivot", "id")).orderBy("_h", "id").limit(pivots).toPandas()
    centers = np.stack(chosen["v"].to_numpy())
    norms = (centers * centers).sum(axis=1)

    def to_pivots(rows, at=slice(None)):
        gap = (rows * rows).sum(axis=1)[:, None] + norms[at] - 2.0 * rows @ centers[at].T
        return np.sqrt(np.maximum(gap, 0.0))

    def home(batches):
        for batch in batches:
            if len(batch):
                batch["cell"], batch["gap"] = _home(np.stack(batch["v"].to_numpy()), to_pivots, len(centers))
                yield batch

    cells = materialize(s.mapInPandas(home, "id bigint, v array<double>, cell int, gap double"), "cells")
    # One row per cell at most: size and the range of distances to its pivot.
    stats = cells.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("gap").alias("lo"), F.max("gap").alias("hi")
    ).toPandas()
    inner, outer = np.full(len(centers), np.inf), np.full(len(centers), -np.inf)
    inner[stats["cell"]], outer[stats["cell"]] = stats["lo"], stats["hi"]
    held = np.zeros(len(centers), dtype=np.int64)
    held[stats["cell"]] = stats["n"]

    def homes(batches):
        for batch in batches:
            if len(batch):
                batch["cell"], _ = _home(np.stack(batch["v"].to_numpy()), to_pivots, len(centers), held > 0)
                yield batch

    near = materialize(q.mapInPandas(homes, "id bigint, v array<double>, cell int"), "homes")
    asked = np.zeros(len(centers), dtype=np.int64)
    for row in near.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        asked[row["cell"]] = row["n"]

    def of_cell(values):
        return F.get(F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>"), F.col("cell"))

    def share(counts):
        """A row's place among the rows of its cell, near enough."""
        return F.pmod(F.xxhash64("id"), of_cell(np.maximum(counts, 1)))

    # First look: one tile of the nearest cell gives a true k-th distance, which bounds how far to look.
    held_tiles, asked_tiles = np.maximum(1, -(-held // tile_rows)), np.maximum(1, -(-asked // tile_rows))
    tile = F.pmod(F.xxhash64("id"), of_cell(asked_tiles)).alias("qt")
    some = cells.filter(F.pmod(F.xxhash64("id"), of_cell(held_tiles)) == 0).select(
        "id", "v", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), of_cell(asked_tiles) - 1)).alias("qt"))

    def look(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "reach": []})
        nearest = _Nearest(a["id"].to_numpy(), np.stack(a["v"].to_numpy()), k)
        nearest.see(b["id"].to_numpy(), np.stack(b["v"].to_numpy()))
        return pd.DataFrame({"query_id": nearest.ids, "reach": nearest.gap[:, -1]})

    reached = near.select("*", tile).groupBy("cell", "qt").cogroup(some.groupBy("cell", "qt")).applyInPandas(look, "query_id bigint, reach double")
    bounded = near.join(materialize(reached, "reach"), F.col("id") == F.col("query_id"), "left").drop("query_id")

    # Blocks of equal size in the order of the cells; a cell lies in one block or in several.
    width = centers.shape[1]
    held_size, asked_size = (_block_rows(int(counts.sum()), width, tile_rows) for counts in (held, asked))
    held_from, asked_from = np.cumsum(held) - held, np.cumsum(asked) - asked
    first, last = held_from // held_size, (held_from + held - 1) // held_size

    def block(counts, start, size):
        return F.floor((of_cell(start) + share(counts)) / F.lit(size)).cast("int")

    def can_hold(gaps, lengths, reach, at=slice(None)):
        """Whether a cell can hold a row within reach, allowing for the digits that the product form loses."""
        margin = 1e-6 * (1.0 + gaps) + 10.0**-DECIMALS + 4e-8 * np.sqrt(width * (lengths[:, None] + norms[at]))
        return (gaps - outer[at] <= reach[:, None] + margin) & (inner[at] - gaps <= reach[:, None] + margin) & (held[at] > 0)

    def pack_queries(group: pd.DataFrame) -> pd.DataFrame:
        points, reach = np.stack(group["v"].to_numpy()), group["reach"].to_numpy(float, copy=True)
        visited = np.zeros(len(centers), dtype=bool)
        for at in range(0, len(points), PART_QUERIES):
            part = slice(at, at + PART_QUERIES)
            gaps = to_pivots(points[part])
            if len(centers) >= k:
                reach[part] = np.fmin(reach[part], np.partition(gaps, k - 1, axis=1)[:, k - 1])
            reach[part][np.isnan(reach[part])] = np.inf
            visited |= can_hold(gaps, (points[part] ** 2).sum(axis=1), reach[part]).any(axis=0)
        with_block = sorted({int(b) for c in np.flatnonzero(visited) for b in range(first[c], last[c] + 1)})
        return pd.DataFrame({
            "qb": [int(group["qb"].iloc[0])], "sbs": [with_block], "id": [group["id"].to_numpy(np.int64).tobytes()],
            "v": [points.tobytes()], "reach": [reach.tobytes()],
        })

    def pack_searched(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["cell", "id"])
        return pd.DataFrame({
            "sb": [int(group["sb"].iloc[0])], "id": [group["id"].to_numpy(np.int64).tobytes()],
            "v": [np.stack(group["v"].to_numpy()).tobytes()], "cell": [group["cell"].to_numpy(np.int32).tobytes()],
        })

    asking = materialize(
        bounded.withColumn("qb", block(asked, asked_from, asked_size)).groupBy("qb")
        .applyInPandas(pack_queries, "qb int, sbs array<int>, id binary, v binary, reach binary"), "asking")
    searched = materialize(
        cells.withColumn("sb", block(held, held_from, held_size)).groupBy("sb")
        .applyInPandas(pack_searched, "sb int, id binary, v binary, cell binary"), "blocks")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "neighbor_id": [], "distance": []})
        ids, cell = np.frombuffer(b["id"].iloc[0], np.int64), np.frombuffer(b["cell"].iloc[0], np.int32)
        rows = np.frombuffer(b["v"].iloc[0]).reshape(-1, width)
        nearest = _Nearest(np.frombuffer(a["id"].iloc[0], np.int64), np.frombuffer(a["v"].iloc[0]).reshape(-1, width), k,
                           np.frombuffer(a["reach"].iloc[0]))
        kinds, starts = np.unique(cell, return_index=True)
        for c, start, stop in zip(kinds, starts, [*starts[1:], len(cell)]):
            at = slice(c, c + 1)
            which = np.flatnonzero(can_hold(to_pivots(nearest.points, at), nearest.squares, nearest.reach, at)[:, 0])
            if len(which):
                nearest.see(ids[start:stop], rows[start:stop], which=which)
        return nearest.found().drop(columns="rank")

    left = asking.withColumn("with", F.explode("sbs")).drop("sbs")
    right = searched.join(asking.select(F.col("qb").alias("of"), F.explode("sbs").alias("sb")), "sb")
    found = left.groupBy("qb", "with").cogroup(right.groupBy("of", "sb")).applyInPandas(search, _PAIR)
    ranked = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def knn_vote(neighbors: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(query_id, prediction): majority label of the neighbours, the smallest one on ties."""
    labeled = neighbors.join(labels.select(F.col(key).cast("bigint").alias("neighbor_id"), label), "neighbor_id")
    votes = labeled.groupBy("query_id", label).agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy("query_id").agg(F.max_by(label, F.struct(F.col("_n"), -F.col(label))).alias("prediction"))


def knn_classify(train: DataFrame, test: DataFrame, key: str, vec: str, label: str, k: int = 3, **search) -> DataFrame:
    """Test rows (key, label, prediction) classified by their k nearest training rows."""
    neighbors = knn_join(test, train, key, vec, k, **search)
    votes = knn_vote(neighbors, train, key, label).withColumnRenamed("query_id", key)
    return test.select(key, label).join(votes, key)


class _Neighbors(HasInputCol, HasLabelCol, HasPredictionCol):
    idCol = Param(Params._dummy(), "idCol", "column that names a row", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)


class _NeighborsWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.train.write.parquet(f"{path}/train")


class _NeighborsReader(MLReader):
    def load(self, path: str) -> KNNClassifierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = KNNClassifierModel(self.sparkSession.read.parquet(f"{path}/train"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class KNNClassifierModel(Model, _Neighbors, MLWritable, MLReadable):
    """Adds the majority label of the k nearest training rows, null for a null vector. The training rows are stored with the model."""

    def __init__(self, train: DataFrame | None = None):
        super().__init__()
        self._setDefault(idCol="id", k=3, predictionCol="prediction")
        self.train = train

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key, vec = self.getOrDefault(self.idCol), self.getInputCol()
        found = knn_join(dataset, self.train, key, vec, self.getOrDefault(self.k))
        votes = knn_vote(found, self.train, key, self.getLabelCol())
        said = votes.select(F.col("query_id").alias("_query"), F.col("prediction").alias(self.getPredictionCol()))
        return dataset.join(said, F.col(key).cast("bigint") == F.col("_query"), "left").drop("_query")

    def write(self) -> MLWriter:
        return _NeighborsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _NeighborsReader()


class KNNClassifier(Estimator, _Neighbors, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the training rows (id, vector, label); what is learned is where they lie."""

    @keyword_only
    def __init__(self, *, idCol="id", inputCol="features", labelCol="label", predictionCol="prediction", k=3):
        super().__init__()
        self._setDefault(idCol="id", inputCol="features", labelCol="label", predictionCol="prediction", k=3)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KNNClassifierModel:
        cols = [self.getOrDefault(self.idCol), self.getInputCol(), self.getLabelCol()]
        model = KNNClassifierModel(materialize(dataset.select(*cols), "knn"))
        model._set(idCol=cols[0], inputCol=cols[1], labelCol=cols[2], predictionCol=self.getPredictionCol(), k=self.getOrDefault(self.k))
        return model


def mutual_nearest(a: DataFrame, b: DataFrame, key: str, vec: str, **search) -> DataFrame:
    """Pairs that are each other's nearest row, as (query_id, neighbor_id, distance)."""
    there = knn_join(a, b, key, vec, 1, **search).drop("rank")
    back = knn_join(b, a, key, vec, 1, **search).select(
        F.col("query_id").alias("neighbor_id"), F.col("neighbor_id").alias("query_id")
    )
    return there.join(back, ["query_id", "neighbor_id"])


def closest(matches: DataFrame, n: int = 50) -> DataFrame:
    return matches.orderBy("distance", "query_id", "neighbor_id").limit(n)


_SUMS = "query_id bigint, own int, other int, total double, n bigint"


def _cluster_sums(query_ids, own, query, clusters, rows):
    """Sum of distances from each query to the rows of each cluster."""
    kinds, member = np.unique(clusters, return_inverse=True)
    sums = np.zeros((len(query), len(kinds)))
    lengths, squares = (query * query).sum(axis=1), (rows * rows).sum(axis=1)
    for start in range(0, len(rows), PART_ROWS):
        some, inside = rows[start : start + PART_ROWS], squares[start : start + PART_ROWS]
        indicator = np.zeros((len(some), len(kinds)))
        indicator[np.arange(len(some)), member[start : start + PART_ROWS]] = 1.0
        for at in range(0, len(query), PART_QUERIES):
            part = query[at : at + PART_QUERIES]
            gaps = part @ some.T
            gaps *= -2.0
            gaps += lengths[at : at + PART_QUERIES, None]
            gaps += inside
            # Below this the product form has lost its digits; take those pairs from differences.
            i, j = np.nonzero(gaps < 1e-6 * (1.0 + inside))
            gaps = np.sqrt(np.maximum(gaps, 0.0, out=gaps), out=gaps)
            gaps[i, j] = _gaps(part, some, i, j)
            sums[at : at + PART_QUERIES] += gaps @ indicator
    return pd.DataFrame({
        "query_id": np.repeat(query_ids, len(kinds)), "own": np.repeat(own, len(kinds)),
        "other": np.tile(kinds, len(query)), "total": sums.ravel(), "n": np.tile(np.bincount(member, minlength=len(kinds)), len(query)),
    })


def silhouette(
    df: DataFrame, key: str, vec: str, cluster: str, broadcast_bytes: int = BROADCAST_BYTES, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Exact mean silhouette under Euclidean distance.

    The measure itself compares every row with every other; the comparison runs block against
    block, a block being a seeded share of the rows whatever their cluster, and only one sum per
    row and cluster leaves a task. ``models.silhouette_squared`` is the linear-time variant. Rows without a vector or a
    cluster take no part.
    """
    rows = df.filter(F.col(vec).isNotNull() & F.col(cluster).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.col(cluster).cast("int").alias("c"), as_double(vec).alias("v")
    )
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if size["n"] * size["d"] * 8 <= broadcast_bytes:
        held = rows.toPandas()
        whole = df.sparkSession.sparkContext.broadcast((held["c"].to_numpy(), np.stack(held["v"].to_numpy())))

        def against_whole(batches):
            for batch in batches:
                if len(batch):
                    yield _cluster_sums(batch["id"].to_numpy(), batch["c"].to_numpy(), np.stack(batch["v"].to_numpy()), *whole.value)

        sums = rows.mapInPandas(against_whole, _SUMS)
    else:
        width = size["d"]
        count = -(-size["n"] // _block_rows(size["n"], width, tile_rows))

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({
                "t": [int(group["t"].iloc[0])], "id": [group["id"].to_numpy(np.int64).tobytes()],
                "c": [group["c"].to_numpy(np.int32).tobytes()], "v": [np.stack(group["v"].to_numpy()).tobytes()],
            })

        def block_sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "own": [], "other": [], "total": [], "n": []})
            ids, own, others = np.frombuffer(a["id"].iloc[0], np.int64), np.frombuffer(a["c"].iloc[0], np.int32), np.frombuffer(b["c"].iloc[0], np.int32)
            query, held = (np.frombuffer(side["v"].iloc[0]).reshape(-1, width) for side in (a, b))
            return _cluster_sums(ids, own, query, others, held)

        placed = rows.withColumn("t", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
        packed = materialize(placed.groupBy("t").applyInPandas(pack, "t int, id binary, c binary, v binary"), "blocks")
        every = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        left = packed.withColumnRenamed("t", "qt").withColumn("st", every)
        right = packed.withColumnRenamed("t", "st").withColumn("qt", every)
        sums = left.groupBy("qt", "st").cogroup(right.groupBy("qt", "st")).applyInPandas(block_sums, _SUMS)
    per_row = sums.groupBy("query_id", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    inside = F.col("own") == F.col("other")
    sides = per_row.groupBy("query_id").agg(
        F.max(F.when(inside, F.col("n"))).alias("n"), F.max(F.when(inside & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~inside, F.col("total") / F.col("n"))).alias("b"),
    )
    score = F.when(F.col("n") < 2, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300)))
    return sides.agg(F.avg(score).alias("silhouette"))
