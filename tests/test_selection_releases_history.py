"""Distributed medians, mergeable distinct counts, releases, copies, quarantine, snapshots, histories, dated lookups."""

import bisect
import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import joins
from tallyspark.operators.distinct import distinct_counts, id_bitmaps, merged
from tallyspark.operators.history import OPEN_END, build_history, current_version
from tallyspark.operators.quality import Check, GateFailed, run_checks
from tallyspark.operators.selection import exact_quantile
from tallyspark.plans import exercises as ex
from tallyspark.plans import gates as gt
from tallyspark.session import scratch_dir, side_by_side
from tallyspark.sources import adapters as ad
from tallyspark.sources import io as sio
from tallyspark.sources.release import Release, write_observed
from tallyspark.sources.tables import snapshot_of, tables, write_snapshots


def plan_of(df):
    return df._jdf.queryExecution().toString()


# ---- medians

def quantile(values, num, den):
    values = sorted(values)
    low, rest = divmod((len(values) - 1) * num, den)
    a = values[low]
    return a + (values[min(low + 1, len(values) - 1)] - a) * (rest / den)


@pytest.mark.parametrize("part", [(1, 2), (0, 1), (1, 1), (1, 4), (99, 100)])
def test_exact_quantiles_of_hot_and_odd_groups(spark, part):
    rng = random.Random(7)
    groups = {
        "hot": [rng.lognormvariate(0, 6) * rng.choice([-1, 1]) for _ in range(3000)],
        "ties": [5.0] * 900 + [7.0] * 100, "even": [1.0, 2.0, 4.0, 8.0], "one": [-3.5],
        "wide": [1e300, -1e300, 1e-300, 0.0, -0.0, 5e-324, 1.0, 1.0 + 2**-52], None: [float(i) for i in range(501)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.quantile, r.n) for r in exact_quantile(df, "v", ["g"], part=part, slice_rows=3).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g][1] == len(vs) and got[g][0] == pytest.approx(quantile(vs, *part), rel=1e-12, abs=0)


def test_weighted_median_equals_expansion_and_uses_no_percentile(spark):
    rows = [(1, 5), (2, 3), (9, 8), (4, 0), (7, None), (None, 4), (2, 1)]
    df = spark.createDataFrame(rows, "v int, n long")
    got = exact_quantile(df, "v", weight="n").first()
    expanded = [v for v, n in rows if v is not None and n for _ in range(n)]
    assert got.quantile == statistics.median(expanded) and got.n == len(expanded)
    big = spark.createDataFrame([(1, 2**61), (3, 2**61)], "v int, n long")
    assert exact_quantile(big, "v", weight="n").first().quantile == 2.0
    assert exact_quantile(df.limit(0), "v").count() == 0
    assert ex.frequency_median(df.limit(0).selectExpr("v AS searches", "n AS num_users")).first().median is None
    freq = spark.createDataFrame([(1, 2), (2, 2)], "searches long, num_users long")
    assert "percentile" not in plan_of(ex.frequency_median(freq)) and ex.frequency_median(freq).first().median == 1.5


# ---- distinct counts

def test_bitmaps_count_and_merge_like_distinct(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.choice([None, 1, 32768, 32769, 10**12, -5, *range(200)]), rng.choice([True, False, None]))
            for _ in range(4000)] + [(0, 77, True)] * 3000
    df = spark.createDataFrame(rows, "w int, id long, ok boolean")
    maps = id_bitmaps(df, ["w"], "id", {"every": None, "good": F.col("ok")})
    for group, key in ((["w"], lambda r: r[0]), ([], lambda r: None)):
        got = {r[0] if group else None: (r.every, r.good) for r in distinct_counts(maps, group, ["every", "good"]).collect()}
        want = {}
        for r in rows:
            if r[1] is not None:
                e, g = want.setdefault(key(r), (set(), set()))
                e.add(r[1])
                if r[2]:
                    g.add(r[1])
        assert got == {k: (len(e), len(g)) for k, (e, g) in want.items()}
    assert merged(maps, [], ["every"]).columns == ["bucket", "every"]
    assert distinct_counts(maps.limit(0), [], ["every"]).first().every == 0


# ---- gates on the write, releases



def checks():
    return [Check("id absent", "missing", "id"), Check("id repeats", "duplicate", "id"),
            Check("v outside", "invalid", "v", valid_min=0, valid_max=9), Check("least", "min", "v", fail_op="<", threshold=0),
            Check("least or equal", "min", "v", fail_op="<=", threshold=-1), Check("big", "failed_rows", predicate=F.col("v") > 8)]


def test_observed_checks_equal_scanned_ones(spark):
    for rows in ([(1, 5), (2, -1), (2, 20), (None, None)], [], [(1, 1)]):
        df = spark.createDataFrame(rows, "id int, v int")
        stored, seen = write_observed(df, "t", checks(), scratch_dir(spark, "t"))
        scanned = {r.check_name: r for r in run_checks(df, "t", checks()).collect()}
        assert {n for _, n, _, _ in seen} == set(scanned) - {"id repeats"} and stored.count() == len(rows)
        for _, name, metric, good in seen:
            assert bool(scanned[name].passed) == good or not rows
            assert scanned[name].metric == metric


def test_release_switches_all_or_nothing(spark):
    root, prefix = scratch_dir(spark, "rel"), "rel_" + scratch_dir(spark, "x")[-12:] + "_"
    one = spark.createDataFrame([(1, 1)], "id int, v int")
    two = spark.createDataFrame([(1, 1), (2, 2)], "id int, v int")
    with Release(spark, root, prefix=prefix) as r:
        assert r.stage("a", one, checks()).count() == 1
        r.stage("b", one)
        assert not spark.catalog.tableExists(f"default.{prefix}a")
    held = spark.table(f"default.{prefix}a")
    assert held.count() == 1
    with pytest.raises(GateFailed):
        with Release(spark, root, prefix=prefix) as r:
            r.stage("a", two)
            r.stage("b", two.unionAll(two), checks())
    with pytest.raises(ZeroDivisionError):
        with Release(spark, root, prefix=prefix) as r:
            r.stage("a", two)
            1 / 0
    with pytest.raises(GateFailed):
        with Release(spark, root, prefix=prefix) as r:
            r.stage("a", two, contract={"id": "integer", "other": "string"})
    assert [spark.table(f"default.{prefix}{n}").count() for n in "ab"] == [1, 1]
    last = Release(spark, root, prefix=prefix)
    last.stage("a", two)
    last.stage("b", two.withColumn("more", F.lit(1)))  # another layout
    last.publish()
    assert [spark.table(f"default.{prefix}{n}").count() for n in "ab"] == [2, 2]
    assert spark.table(f"default.{prefix}b").columns == ["id", "v", "more"]
    last.vacuum()
    assert spark.table(f"default.{prefix}a").count() == 2
    for n in "ab":
        spark.sql(f"DROP TABLE default.{prefix}{n}")


def test_stored_gates_equal_lazy_gates(spark, sf_small):
    t = tables(spark, sf_small)
    raw, country = ad.raw_invoices(t), ad.country_reference(t)
    lazy, stored = gt.gate_results(raw, country), gt.gate_results(raw, country, store=lambda df, name: df)
    assert sorted(map(tuple, lazy.collect())) == sorted(map(tuple, stored.collect()))


# ---- copies and CSV

def test_copies_run_side_by_side_and_report_failures(spark, sf_small):
    dst = scratch_dir(spark, "copies")
    audit = sio.copy_tables(spark, sf_small, ["nation", "absent", "region"], dst, on_error="report").collect()
    got = {r.table_name: r for r in audit}
    assert got["nation"].rows_imported == 25 and got["region"].status == "loaded"
    assert got["absent"].rows_imported is None and got["absent"].status.startswith("failed") and got["absent"].seconds >= 0
    with pytest.raises(RuntimeError, match="absent"):
        sio.copy_tables(spark, sf_small, ["absent", "region"], dst)
    assert spark.read.parquet(f"{dst}/src_region.parquet").count() == 5
    with pytest.raises(ValueError):
        sio.copy_tables(spark, sf_small, [], dst, on_error="ignore")
    with pytest.raises(ZeroDivisionError):
        side_by_side([lambda: 1, lambda: 1 / 0])
    assert side_by_side([lambda: 1, lambda: 2]) == [1, 2] and side_by_side([]) == []


def test_malformed_lines_are_quarantined(spark):
    path = scratch_dir(spark, "csv")
    lines = ['1,A,"x, y",3,d,1.5,2.0,NA', "2,A,x,3", "3,A,x,3,d,1.5,2.0,C,extra", "4,A,x,three,d,1.5,2.0,C", "5,,,,,,,"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    typed, rejected = sio.read_csv_quarantine(spark, path, header=False)
    assert sorted((r.InvoiceNo, r.Description, r.Country) for r in typed.collect()) == [("1", "x, y", "NA"), ("5", None, None)]
    assert sorted(r.line for r in rejected.collect()) == sorted(lines[1:4])
    assert all(r.file.startswith("part-") for r in rejected.collect())
    spark.createDataFrame([], "value string").write.mode("overwrite").text(path)
    assert [d.count() for d in sio.read_csv_quarantine(spark, path, header=False)] == [0, 0]


# ---- snapshots and scalar subqueries

def test_snapshots_are_pruned_when_the_query_runs(spark):
    df = spark.createDataFrame([(i, f"m{i % 5}") for i in range(100)], "v int, snapshot string")
    path, params = scratch_dir(spark, "snap"), scratch_dir(spark, "params")
    write_snapshots(df, path, "snapshot")
    spark.createDataFrame([("report", "m3"), ("other", "m1")], "name string, snapshot string").write.parquet(params)
    wanted = spark.read.parquet(params).filter("name = 'report'")
    got = snapshot_of(spark.read.schema(df.schema).parquet(path), "snapshot", wanted)
    assert sorted(r.v for r in got.collect()) == [i for i in range(100) if i % 5 == 3]
    assert "dynamicpruning" in plan_of(got).lower()


def test_packing_through_scalar_subqueries(spark):
    def run(rows, area=100):
        inv = spark.createDataFrame(rows, "item_type string, square_footage long")
        return {r.item_type: r.item_count for r in ex.warehouse_packing(inv, area).collect()}

    p, n = ex.PRIME, ex.NOT_PRIME
    assert run([(p, 30), (p, 10), (n, 7), (n, None), (None, 4), ("x", 1)]) == {p: 4, n: 4}
    assert run([(n, 7)]) == {n: None} and run([]) == {} and run([(p, 0)]) == {p: None}
    area = spark.createDataFrame([(100,)], "area int")
    assert run([(p, 40), (n, 20)], area) == {p: 2, n: 1} and run([(p, 40)], area.limit(0)) == {p: None}
    inv = spark.createDataFrame([(p, 40), (n, 20)], "item_type string, square_footage long")
    plan = plan_of(ex.warehouse_packing(inv, area))
    assert "scalar-subquery" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


# ---- histories

def brute_history(rows):
    by_key = {}
    for k, t, i, v in rows:
        by_key.setdefault(k, {})
        if t not in by_key[k] or by_key[k][t][0] < i:
            by_key[k][t] = (i, v)
    out = []
    for k, changes in by_key.items():
        kept = []
        for t in sorted(changes):
            v = changes[t][1]
            if not kept or kept[-1][1] != v:
                kept.append((t, v))
        out += [(k, v, t, kept[j + 1][0] if j + 1 < len(kept) else dt.datetime.fromisoformat(OPEN_END)) for j, (t, v) in enumerate(kept)]
    return out


def test_history_of_hot_keys_equals_brute_force(spark):
    rng = random.Random(6)
    start = dt.datetime(2020, 1, 1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), start + dt.timedelta(hours=rng.randrange(900)), i,
             rng.choice(["x", "x", "y", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, t timestamp, i int, v string").repartition(6)
    hist = build_history(df, "k", ["t", "i"], ["v"], num_partitions=9)
    key = lambda r: tuple(str(x) for x in r)
    got = [(r.k, r.v, r.effective_from, r.effective_to) for r in hist.collect()]
    assert sorted(got, key=key) == sorted(brute_history(rows), key=key)
    assert current_version(hist).count() == len({k for k, *_ in rows})
    assert build_history(df.limit(0), "k", ["t", "i"], ["v"]).count() == 0


# ---- dated lookups

def test_lookup_in_many_rules_with_one_hot_day_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    base = dt.date(1700, 1, 1)
    starts = sorted(rng.sample(range(300_000), 100_000))
    ivs = []
    for i, s in enumerate(starts):
        end = starts[i + 1] - 1 if i + 1 < len(starts) else 2_000_000
        ivs.append((base + dt.timedelta(days=s), base + dt.timedelta(days=min(end, s + rng.randrange(4))), i))
    rules = spark.createDataFrame(ivs, "valid_from date, valid_to date, v int")
    hot = base + dt.timedelta(days=starts[500])
    days = [hot] * 3000 + [base + dt.timedelta(days=rng.randrange(-5, 300_010)) for _ in range(2000)] + [None] * 3
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(days)], "i int, d date, row string")
    got = {r.i: r.v for r in joins.effective_dated_lookup(df, "d", rules, "v").collect()}
    begins = [f for f, _, _ in ivs]

    def brute(d):
        at = bisect.bisect_right(begins, d) - 1 if d else -1
        return ivs[at][2] if at >= 0 and d <= ivs[at][1] else None

    assert got == {i: brute(d) for i, d in enumerate(days)}


def test_tree_and_merge_agree_and_open_ended_rules_stay_small(spark):
    rules = spark.createDataFrame(
        [(1, dt.date(2020, 1, 5), dt.date(5999, 12, 31), "a"), (0, dt.date(2020, 2, 1), dt.date(2020, 2, 10), "b"),
         (2, dt.date(1900, 1, 1), dt.date(2020, 3, 1), "c"), (3, dt.date(2020, 5, 2), dt.date(2020, 5, 1), "empty")],
        "priority int, valid_from date, valid_to date, v string")
    ivs = joins.resolve_effective_rules(rules, "v")
    assert ivs.count() == 5  # c, a, b, a to the end of c, a
    df = spark.createDataFrame([(i, dt.date(2019, 12, 20) + dt.timedelta(days=i)) for i in range(90)] + [(99, None)], "i int, d date")
    tree = joins.effective_dated_lookup(df, "d", ivs, "v")
    merge = joins.effective_dated_lookup(df, "d", ivs, "v", tree_intervals=0)
    assert sorted(map(str, tree.collect())) == sorted(map(str, merge.collect()))
    assert {r.v for r in tree.filter("d BETWEEN '2020-02-01' AND '2020-02-10'").collect()} == {"b"}
    assert "Join" not in plan_of(tree).split("== Physical Plan ==")[-1].split("Scan")[0]
    none = joins.effective_dated_lookup(df, "d", ivs.limit(0), "v")
    assert none.filter("v IS NOT NULL").count() == 0 and none.count() == 91
