"""Short tables meet the rows without shuffling them, and what a plan reads twice is stored once."""

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import jaccard_join, quality


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _docs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, ["en", "de", None][i % 3], f"s{i % 4}", " ".join(f"w{w}" for w in rng.integers(0, 400, 60 + i % 50)))
            for i in range(240)]
    return spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")


def test_estimates_are_sent_to_the_rows_however_large_their_files_look(spark, monkeypatch):
    plans, store = [], quality.store

    def noted(df, name="stage"):
        plans.append(_plan(df))
        return store(df, name)

    monkeypatch.setattr(quality, "store", noted)
    docs = _docs(spark)
    want = {r.doc_id: r.kept for r in quality.quality_verdicts(docs).collect()}
    plans.clear()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        good = quality.keep_good(docs)
        assert all("SortMergeJoin" not in p for p in [*plans, _plan(good)])
        assert {r.doc_id for r in good.collect()} == {k for k, v in want.items() if v}
        # of many estimates none is broadcast by force
        plans.clear()
        monkeypatch.setattr(quality, "SENT", 0)
        good = quality.keep_good(docs)
        assert any("SortMergeJoin" in p for p in plans) and all("BroadcastHashJoin" not in p for p in plans)
        assert {r.doc_id for r in good.collect()} == {k for k, v in want.items() if v}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_hubs_are_made_once(spark):
    # the token 0 is in every list, so its rows are hot and looked up apart from the others
    lists = [(t, e, 100, 0, e) for e in range(600) for t in (0, 1 + e // 2)]
    lists = spark.createDataFrame(lists, "token long, e long, n int, pos int, c long")
    sizes = lists.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    pairs, path = jaccard_join._star_pairs(lists, None, sizes)
    assert "map_from_entries" not in _plan(pairs)
    found = {(r.a, r.b) for r in pairs.collect()}
    hubs = {r.token: r.hubs for r in spark.read.parquet(path).collect()}
    assert len(hubs) == 301
    want = {(e, h.e) for e in range(600) for t in (0, 1 + e // 2) for h in hubs[t].values() if h.e != e}
    assert found == want and len({b for a, b in found}) > 200
