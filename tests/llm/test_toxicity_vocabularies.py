"""Operator 8 learns vocabularies of unequal share, and the landmark choice covers each of them."""

import random

from tallyspark.llm.toxicity import pick_landmarks, toxicity_verdicts


def test_landmarks_cover_small_vocabularies_too():
    common = {f"big{i}": set(range(900)) - set(range(i, 900, 10)) for i in range(10)}
    small = {f"small{i}": set(range(1000 + i, 1040, 2)) for i in range(2)}
    best = pick_landmarks({**common, **small, "once": {5000}}, 12)
    assert "small0" in best and "small1" in best and "once" not in best
    assert pick_landmarks({}, 5) == []


def test_four_vocabularies_of_unequal_share_are_found(spark, documents):
    rng = random.Random(8)
    letters = ["abcdefgh", "ijklmnop", "qrstuvwx", "aeioulmr"]
    stems = [["kazzik", "zombur"], ["pillox", "monnik"], ["vurstq", "xuttar"], ["olearm", "umarie"]]
    tails = ["a", "en", "ot", "ist", "ur", "el", "or", "im"]
    word = lambda v: "".join(rng.choice(letters[v]) for _ in range(rng.randint(3, 9)))
    rows, marks, kind = [], [], {}
    for i in range(2400):
        v = rng.choices(range(4), [70, 15, 10, 5])[0]
        words = [word(v) for _ in range(rng.randint(40, 90))]
        toxic = rng.random() < 0.3
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(stems[v]) + rng.choice(tails)
        rows.append((i, " ".join(words), "en"))
        marks.append((i, int(toxic)))
        kind[i] = (v, toxic)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    found = {r.doc_id: r.predicted for r in toxicity_verdicts(documents(rows), labels).filter("held_out").collect()}
    for v in range(4):
        toxic = [found[i] for i in found if kind[i] == (v, True)]
        clean = [found[i] for i in found if kind[i] == (v, False)]
        assert sum(toxic) >= 0.8 * len(toxic), (v, sum(toxic), len(toxic))
        assert sum(clean) <= 0.03 * len(clean), (v, sum(clean), len(clean))
