"""Labelled rows for the trained scorers: what is held out, and bounded seeded samples of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.session import materialize


def held_out(id_col: str, parts: int, rest: int) -> Column:
    """Whether the CRC-32 of the id as text leaves ``rest``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == rest


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, per_label: dict[int, int], id_col: str = "doc_id",
    text_col: str = "text", seed: int = 17,
) -> DataFrame:
    """(doc_id, text, label) of about ``per_label[label]`` labelled documents each, all where there are fewer; written.

    The labelled ids are drawn first, by a hash, so what is joined with the documents is bounded by ``per_label`` and goes to them as a
    broadcast; no text is shuffled. Ids without a document give no row, null ids and labels other than 0 and 1 are left out.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("label")
    ).distinct()
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(seed), "of"), F.lit(1 << 20))
    chosen = F.lit(False)
    for label, n in per_label.items():
        chosen = chosen | ((F.col("label") == label) & (draw < int((1 << 20) * min(1.0, n / max(counts.get(label, 0), 1)))))
    drawn = materialize(known.filter(chosen), "drawn")
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(given.join(F.broadcast(drawn), F.col("doc_id") == F.col("of")).select("doc_id", "text", "label"), "labelled")
