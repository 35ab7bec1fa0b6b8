"""Point transforms and the robust fit of a similarity between matched points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.seeded import hash_key
from cohortwise.session import materialize


def affine(df: DataFrame, x: str, y: str, matrix: list[list[float]]) -> DataFrame:
    """Apply a 2 x 3 matrix to the point columns."""
    (a, b, c), (d, e, f) = matrix
    px, py = F.col(x), F.col(y)
    return df.withColumns({x: a * px + b * py + F.lit(c), y: d * px + e * py + F.lit(f)})


def bounding_box(df: DataFrame, x: str, y: str) -> DataFrame:
    """Whole-number box around all points: floor of the minima, ceiling of the maxima."""
    return df.agg(
        F.floor(F.min(x)).alias("x_min"), F.floor(F.min(y)).alias("y_min"),
        F.ceil(F.max(x)).alias("x_max"), F.ceil(F.max(y)).alias("y_max"),
    ).withColumns({"width": F.col("x_max") - F.col("x_min"), "height": F.col("y_max") - F.col("y_min")})


def _similarity(a, b, tx, ty, x, y):
    return a * x - b * y + tx, b * x + a * y + ty


def consensus_similarity(matches: DataFrame, key: str, tolerance: float, hypotheses: int = 100, seed=42) -> DataFrame:
    """Similarity (a, b, tx, ty) between matched points (x, y) and (u, v) with most inliers.

    Seeded pairs of matches each fix one hypothesis; the bounded list of hypotheses goes to the
    matches as one value and a partial count per task is all that is shuffled. The winner is
    fitted again to its inliers by least squares.
    """
    if len(matches.select(key).head(3)) < 3:
        raise ValueError("at least 3 matches are needed")
    sample = matches.withColumn("_h", hash_key(seed, key)).orderBy("_h", key).limit(2 * hypotheses)
    # At most 2 * hypotheses rows: pair them up in seeded order inside one array.
    points = sample.agg(F.array_sort(F.collect_list(F.struct("_h", "x", "y", "u", "v"))).alias("ps")).select(
        F.posexplode(F.expr("transform(sequence(1, greatest(1, size(ps) div 2)), i -> struct(ps[2 * i - 2] AS p, ps[2 * i - 1] AS q))")).alias("h", "pair")
    )
    dx, dy = F.col("pair.q.x") - F.col("pair.p.x"), F.col("pair.q.y") - F.col("pair.p.y")
    du, dv = F.col("pair.q.u") - F.col("pair.p.u"), F.col("pair.q.v") - F.col("pair.p.v")
    norm = dx * dx + dy * dy
    models = (
        points.filter(norm > 0)
        .withColumns({"a": (du * dx + dv * dy) / norm, "b": (dv * dx - du * dy) / norm})
        .withColumns({
            "tx": F.col("pair.p.u") - F.col("a") * F.col("pair.p.x") + F.col("b") * F.col("pair.p.y"),
            "ty": F.col("pair.p.v") - F.col("b") * F.col("pair.p.x") - F.col("a") * F.col("pair.p.y"),
        })
        .select("h", "a", "b", "tx", "ty")
    )
    packed = models.agg(F.collect_list(F.struct("h", "a", "b", "tx", "ty")).alias("ms"))
    held = matches.select("x", "y", "u", "v", F.explode(packed.scalar()).alias("m"))

    def miss(m):
        px, py = _similarity(F.col(f"{m}.a"), F.col(f"{m}.b"), F.col(f"{m}.tx"), F.col(f"{m}.ty"), F.col("x"), F.col("y"))
        return F.round(F.sqrt((px - F.col("u")) ** 2 + (py - F.col("v")) ** 2), 9)

    votes = held.filter(miss("m") < tolerance).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    best = materialize(votes.agg(F.max_by("m", F.struct(F.col("n"), -F.col("m.h"))).alias("m")), "consensus")
    if best.first()["m"] is None:
        raise ValueError("no two of the sampled points differ, or nothing fits within the tolerance")
    inliers = matches.select("x", "y", "u", "v").withColumn("m", best.scalar()).filter(miss("m") < tolerance)
    sums = inliers.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyuv"],
        *[F.avg(F.col(p) * F.col(q)).alias(p + q) for p, q in ("xx", "yy", "xu", "yv", "xv", "yu")],
    )
    spread = F.col("xx") + F.col("yy") - F.col("mx") ** 2 - F.col("my") ** 2
    along = F.col("xu") + F.col("yv") - F.col("mx") * F.col("mu") - F.col("my") * F.col("mv")
    across = F.col("xv") - F.col("yu") - F.col("mx") * F.col("mv") + F.col("my") * F.col("mu")
    return sums.withColumns({"a": along / spread, "b": across / spread}).select(
        F.col("n").alias("inliers"), "a", "b",
        (F.col("mu") - F.col("a") * F.col("mx") + F.col("b") * F.col("my")).alias("tx"),
        (F.col("mv") - F.col("b") * F.col("mx") - F.col("a") * F.col("my")).alias("ty"),
    )
