"""The mixing query's rows come from the training order."""

from pyspark.sql import functions as F

from cohortwise.llm import mixing
from cohortwise.llm.queries import QUERIES


def test_rows_agree_with_the_order(spark):
    rows = [(i % 7 if i % 5 else None, " ".join(["w"] * (i % 9)) if i % 8 else None, "abc"[i % 3]) for i in range(60)]
    mixed = mixing.mixture(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    got, order = mixing.dealt(mixed).collect(), mixing.training_order(mixed).collect()
    assert len(got) == len(rows) and any(r["copies"] == 0 for r in got) and any(r["copies"] > 1 for r in got)
    assert all(r["taken"] == r["size"] * r["copies"] and (r["first_position"] is None) == (r["copies"] == 0) for r in got)
    ends = {r["first_position"] for r in got if r["copies"]} | {r["last_position"] for r in got if r["copies"]}
    at = {r["position"]: r["at"] for r in order}
    assert {0, len(order) - 1} <= ends <= set(at)
    assert all((r["first_at"], r["last_at"]) == (at[r["first_position"]], at[r["last_position"]]) for r in got if r["copies"])


def test_query_takes_what_the_order_holds(spark, folder, monkeypatch):
    whole, made = QUERIES["op7_source_mixing"](spark, folder).agg(F.sum("taken")).first()[0], mixing.training_order
    monkeypatch.setattr(mixing, "training_order", lambda mixed, schedules=None: made(mixed, schedules).filter("position % 2 = 0"))
    assert 0 < QUERIES["op7_source_mixing"](spark, folder).agg(F.sum("taken")).first()[0] < whole
