"""MinHash near-dedup: finished stars, and the buckets that are made."""

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import minhash, repeats, star_components
from tallyspark.llm.text import mix


def test_finished_stars_are_not_worked_through_again(spark, monkeypatch):
    steps = []
    for name in ("_large_star", "_small_star"):
        monkeypatch.setattr(star_components, name, lambda edges, f=getattr(star_components, name): steps.append(1) or f(edges))
    stars = [(i, i // 10 * 10) for i in range(100) if i % 10]
    got, _ = star_components.star_components(spark.createDataFrame(stars, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(i, i // 10 * 10) for i in range(100)] and not steps
    for more in ([(3, 12)], [(0, 10)], [(5, 5 + 10 * k) for k in range(10)]):
        got, _ = star_components.star_components(spark.createDataFrame(stars + more, "a long, b long"))
        names = dict(map(tuple, got.collect()))
        joined = {x // 10 * 10 for p in more for x in p}
        assert names == {i: 0 if i // 10 * 10 in joined else i // 10 * 10 for i in range(100)} and steps


def test_buckets_outside_the_map_are_not_made(spark):
    sets = [mix(np.arange(100 * i, 100 * i + 90, dtype=np.uint64)) for i in range(40)]
    rows = [(bytes([i]), 90, s) for i, s in enumerate(minhash.signatures([*sets[:-1], np.r_[sets[0][:-1], sets[-1][:1]]]))]
    classes = spark.createDataFrame(rows, "e binary, n long, sig binary")
    every = minhash._buckets(classes)
    counts = every.groupBy("bucket").count().filter("count > 1")
    seen = repeats.build(counts.select(F.col("bucket").alias("key")), minhash._id_keys, counts.count(), keep_seen=True)
    few = minhash._buckets(classes, seen)
    assert few.count() < every.count() / 10
    wanted = sorted(map(tuple, every.join(counts, "bucket").select("bucket", "e", "n").collect()))
    assert wanted and sorted(map(tuple, few.join(counts, "bucket").select("bucket", "e", "n").collect())) == wanted
