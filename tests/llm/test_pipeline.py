"""The pipeline's stages, each on all that its predecessor kept, against brute force."""

import random
import re

import corpus_pipeline
from test_tokens import targets

import __spark_entry__ as entry


def test_stages_names_and_queries():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "quality_rules", "exact_copies", "near_copies", "source_mix", "tokens"]
    names = entry.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_pipeline_takes_effect(spark, documents, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8)))
    clean = [(i, " ".join(word() for _ in range(rng.randint(80, 300))), "en", f"s{i % 3}") for i in range(200)]
    copies = [(300 + i, clean[i][1].replace(" ", "  "), "en", "s0") for i in range(20)]
    near = [(400 + i, clean[30 + i][1] + " tail", "en", "s1") for i in range(20)]
    poor = [(500 + i, "too short", "en", "s2") for i in range(10)] + [(600, None, "en", "s2"), (601, "x y z " * 90, "en", "s2")]
    docs = documents(clean + copies + near + poor)
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    kept = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, path)
        seen.append(kept.collect())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert kept.columns == docs.columns
    ids = [sorted(r.doc_id for r in rows) for rows in seen]
    assert set(ids[0]) == {r[0] for r in clean + copies + near}
    assert set(ids[1]) == {r[0] for r in clean + near}
    assert set(ids[2]) == {r[0] for r in clean}
    sizes = {}
    for r in seen[2]:
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in seen[3]:
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - want[s]) <= 1 + 0.001 * want[s] for s in sizes)
    assert len(seen[4]) == len(seen[3])


def test_pipeline_of_empty_tables_null_sources_and_repeated_ids(spark, documents, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(120))
    for name, rows in (("none", []), ("some", [(i % 30, text(), "en", None if i % 2 else "s") for i in range(60)])):
        docs = documents(rows)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        ids = {r[0] for r in rows}
        assert {r.doc_id for r in got} <= ids and (len(got) > 30) == bool(rows)


def test_round_trip_step_equals_encode_and_decode(spark, documents):
    from tallyspark.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip

    docs = documents([(1, "Some text, ünïcode \n\n twice"), (2, None), (3, ""), (4, "word " * 30_000)])
    both = bpe_decode(bpe_encode(docs))
    one = bpe_round_trip(docs)
    assert one.columns == [c for c in both.columns if c != "text"]
    assert sorted(map(str, one.collect())) == sorted(map(str, both.select(*one.columns).collect()))
