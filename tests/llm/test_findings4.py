"""Findings of round 4: the training-data operators."""

import random

from tests.llm.test_round3 import audited, frame, rows_of
from tokenledger.llm import common, filter_audit


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_never_broadcast(spark):
    a, b = spark.range(100), common.save(spark.range(50), "small-files")
    assert "BroadcastHashJoin" in plan_of(a.join(common.bounded(b, 50), "id"))
    for how in ("inner", "left", "left_semi", "left_anti"):  # a file of 50 rows is below Spark's own threshold
        out = a.join(common.bounded(b, 49), "id", how)
        out.collect()
        assert "Broadcast" not in plan_of(out) and "SortMergeJoin" in plan_of(out)


def test_filter_audit_broadcasts_no_table_that_grows(spark, monkeypatch):
    plans = []

    def saved(df, name):
        plans.append(plan_of(df))
        return common.save(df, name)

    monkeypatch.setattr(filter_audit, "save", saved)
    monkeypatch.setattr(filter_audit, "bounded", lambda df, limit: common.bounded(df, -1))
    monkeypatch.setattr(filter_audit, "REPEATED", -1, raising=False)
    rows = rows_of(random.Random(6))
    labels = [(3, 1, 0), (8, 1, 1), (12, 1, None), (20, 0, 1), (20, 1, 0), (None, 1, 1), (53, 1, 0)]
    got = filter_audit.audit(frame(spark, rows).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audited(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want and len(got) == len(want)
    assert not any("Broadcast" in p for p in plans) and sum("SortMergeJoin" in p for p in plans) == 7
