"""Helpers for whole rows: free column names, joins on id and text, bounded broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.session import materialize


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many leading underscores as it takes to differ from every column of ``df``."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


MOST_BYTES = 24 << 20


def written_bytes(table: DataFrame) -> int:
    """The size of the folder behind a table that ``materialize`` has written."""
    files = table.inputFiles()
    if not files:
        return 0
    folder = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    return folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def release(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``materialize`` has written and that nothing reads any more."""
    for table in tables:
        files = table.inputFiles()
        if files:
            folder = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def bounded_broadcast(table: DataFrame, rows: int = 500_000, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A written table marked for broadcast if it has at most ``rows`` rows in ``most_bytes`` of files, else as it is, for a shuffled join."""
    small = table.limit(rows + 1).count() <= rows and written_bytes(table) <= most_bytes
    return F.broadcast(table) if small else table


def matching(docs: DataFrame, keys: DataFrame, how: str, id_col: str, text_col: str) -> DataFrame:
    """Join ``docs`` with the columns of ``keys`` after its first two, an id and the hash of a text; nulls match nulls.

    The columns of ``keys`` must not be named like any of ``docs``.
    """
    of, key = keys.columns[:2]
    same = F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(text_col) == F.col(key))
    joined = docs.join(bounded_broadcast(keys), same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(of, key)


def distinct_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of those that agree in id and text. Only such rows are shuffled whole."""
    of, key = fresh(docs, "_of", "_key")
    slim = docs.select(F.col(id_col).alias(of), F.xxhash64(text_col).alias(key))
    repeated = materialize(slim.groupBy(of, key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated")
    if repeated.isEmpty():
        return docs
    once = matching(docs, repeated, "left_anti", id_col, text_col)
    return once.unionByName(matching(docs, repeated, "left_semi", id_col, text_col).dropDuplicates([id_col, text_col]))
