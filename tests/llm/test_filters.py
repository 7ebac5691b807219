"""Operators 6 to 9: URL filters, personal data, toxicity and quality rules."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import quality, toxicity
from tallyspark.llm.boosted import train
from tallyspark.llm.pii import base_spans, candidate_spans, example_groups, find_pii, listed, redact, train_pii
from tallyspark.llm.url_filter import entropy, host_and_path, judge_urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/")]


def test_boosted_trees_equal_the_library(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = random.Random(1)
    rows = [([rng.random(), float(rng.randrange(5))],) for _ in range(400)]
    df = spark.createDataFrame(rows, "x array<double>").withColumn(
        "label", ((F.col("x")[0] * 5 + F.col("x")[1] > 4) & (F.col("x")[1] != 2)).cast("int")).coalesce(1)
    trees = train(df, rounds=5, depth=3, parts=1)
    data = df.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"), "x")
    model = GBTClassifier(maxIter=5, maxDepth=3, stepSize=0.3, seed=7).fit(data)
    both = model.transform(data).select(vector_to_array("probability")[1].alias("a"),
                                        trees.probability(lambda i: F.col("x")[i]).alias("b")).collect()
    assert max(abs(r.a - r.b) for r in both) < 1e-9
    assert train(df.filter("label = 1")) is None and train(df.limit(0)) is None


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return host.translate({c: c + 32 for c in range(65, 91)}), path


URLS = [None, "", "no scheme", "http://", "http://A.ORG", "https://x.Example.org/en/1?q", "http://example.org/en/12/a#b",
        "http://example.org/es/x", "ftp://notexample.org/es/", "http://b.com/fr/://c", "http://ÄB.com/fr/", "x://y?z/",
        "http://a.net/" + "p/" * 5000, "://org/", "http://org/\n/x"]


def test_hosts_rules_and_verdicts(spark):
    rng = random.Random(2)
    urls = URLS + [f"http://{rng.choice(['a', 'b.c', 'free-bets'])}.example.{rng.choice(['org', 'net', 'com'])}"
                   f"/{rng.choice(['en', 'es', 'fr'])}/{rng.randrange(300)}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, x int")
    got = {r.page_id: r for r in judge_urls(df, RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = plain_host_path(u)
        fits = [(len(t), t, k) for k, t in RULES for own, begin in [t.split("/", 1)]
                if (host == own or host.endswith("." + own)) and path.startswith("/" + begin)]
        rule = max(fits, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[1])
        assert got[i].verdict == rule[2] if rule else got[i].verdict in ("allow", "block")
    assert judge_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in judge_urls(df, []).collect()} == {"allow"}


def test_urls_learned_from_rules_generalise(spark):
    rng = random.Random(6)
    urls = [f"http://{'x' * rng.randint(3, 9)}{'-' if bad else ''}y.example.{tld}/{'9' * 8 * bad}{'a' * rng.randint(1, 9)}"
            for bad in (0, 1) for tld in ("com", "net") for _ in range(150)]
    rules = [("block", f"{'x' * n}-y.example.com/") for n in range(3, 10)] + [("allow", "com/")]
    got = judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules)
    open_ = [r for r in got.collect() if r.rule is None]
    assert len(open_) == 300
    assert sum((r.verdict == "block") == ("-" in r.host) for r in open_) >= 290


def test_urls_of_rare_suffixes_keep_their_block_share(spark):
    """Open URLs under 600 domains of equal size, told apart only by what the rules decide on the same domain."""
    urls = [f"http://{host}.d{k:03d}.com/{part}/x{n}" for k in range(600) for host, part, n in
            (("a", "fr" if k % 2 else "de", 1), ("b", "fr" if k % 2 else "de", 2), ("c", "it", 3))]
    rules = [("allow", "com/fr/"), ("block", "com/de/")]
    got = judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules,
                     max_rows=400).collect()
    open_ = [r for r in got if r.rule is None]
    assert len(got) == 1800 and len(open_) == 600
    assert all((r.verdict == "block") == (int(r.host[3:6]) % 2 == 0) for r in open_)


def test_entropy(spark):
    rows = ["", "aaaa", "ab", "abca", "x.y|z\\*", "ééa"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(entropy(F.col("t"))).collect()]
    for t, e in zip(rows, got):
        want = -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0
        assert abs(e - want) < 1e-9


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(t):
    out = []
    for i, (k, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[k]
            if fine:
                out.append((m.start(), i, m.end(), k))
    return ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(out))


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(3)
    bits = list("0123456789") * 3 + list("+.-() @ab%_é\n") + [
        "a@b.c", "x_y@m-n.oo.p", "1.2.3.4", "256.1.1.1", "007.1.2.3", "+1 (234) 555-1234", "4111 1111 1111 1111", " x "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(2500)]
    texts += [None, "", "a@b.c@d.e_f@g.h", "9" * 3000, "1.2.3.4.5.6.7.8.9", "a@b.c " * 900, "1 " * 2000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    got = dict(df.select("doc_id", listed(base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect())
    assert [got[i] for i in range(len(texts))] == [plain_spans(t or "") for t in texts]


def test_scans_of_long_texts_are_linear(spark):
    texts = ["a" * 500_000, "1" * 500_000, "1 " * 250_000, "+1" * 100_000, "1.1.1" * 60_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    got = df.select(F.size(base_spans(F.col("t"))) + F.size(candidate_spans(F.col("t")))).collect()
    assert len(got) == 5


def test_pii_adds_spans_and_keeps_the_base(spark, documents):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(90)}" for _ in range(20)]
        words[5] = rng.choice(["+1 (%03d) 555-%04d" % (rng.randrange(999), rng.randrange(9999)), "n%d" % i, "12 34 567 8",
                               "me.%d@mail.org" % i, "you %d at home" % i, "90-%d" % i])
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (None, "+1 (222) 555-1234"), (1, rows[1][1])]
    docs = documents(rows)
    found = find_pii(docs).select("doc_id", listed(F.col("base")).alias("base"), "added").collect()
    assert sorted((str(r.doc_id), r.base) for r in found) == sorted((str(i), plain_spans(t or "")) for i, t in rows)
    assert sum(len(r.added) for r in found) < 40
    out = {r.doc_id: r.text for r in redact(docs.filter("doc_id >= 2 AND doc_id < 400")).collect()}
    for i, t in rows[2:400]:
        if "mail.org" in t:
            assert out[i] == re.sub(r"me\.\d+@mail\.org", "[PII]", t)
    assert find_pii(documents([])).count() == 0


def test_pii_learns_from_all_documents(spark):
    # only rows that a pick of 20,000 by their ids leaves out hold examples of both labels
    picked = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < (1 << 29)
    number = F.lpad(F.col("doc_id").cast("string"), 6, "0")
    told = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("call +1 555 "), number)).otherwise(F.concat(F.lit("order 10/"), number))
    docs = spark.range(40_000).select(F.col("id").alias("doc_id")).withColumn("text", F.when(picked, "nothing").otherwise(told))
    assert train_pii(docs) is not None
    rest = docs.filter(~picked).count()
    assert example_groups(docs).filter("kind = 'number'").agg(F.sum("n")).first()[0] == rest


def test_pii_adds_what_the_base_does_not_match(spark, documents):
    rng = random.Random(14)
    rows = []
    for i in range(600):
        words = [f"w{'abcdefgh'[rng.randrange(8)]}{'xyz'[rng.randrange(3)]}" for _ in range(20)]
        words[5] = rng.choice(["+1 (%03d) 555-%04d" % (rng.randrange(999), rng.randrange(9999)), "me.%d@mail%d.org" % (i, i % 7),
                               "%08d" % rng.randrange(10 ** 8), "12 34 567 8", "2024-%02d-%02d" % (1 + i % 12, 1 + i % 28),
                               "user@localhost", "97.51.%d.173" % rng.randrange(256)])
        rows.append((i, " ".join(words)))
    rows += [(1000, "wa wb (555) 123-4567 wc"), (1001, "wa me [at] mail.org wc"), (1002, "wa 73920418 wc"),
             (1003, "wa look [at] this wc"), (1004, "wa 2023-11-30 wc"), (1005, "wa user@localhost wc")]
    rows += [(2000 + i, "wx wy (%03d) 555-%04d wz" % (i * 7, i * 31)) for i in range(60)]
    found = {r.doc_id: [(s["start"], s["end"]) for s in r.added] for r in find_pii(documents(rows)).collect()}
    assert {i: found[i] for i in range(1000, 1006)} == {
        1000: [(6, 20)], 1001: [(3, 19)], 1002: [], 1003: [], 1004: [], 1005: []}
    assert not any(found[i] for i in range(600)) and all(found[2000 + i] == [(6, 20)] for i in range(60))


def plain_kernel(s, t, order=toxicity.ORDER, decay=toxicity.DECAY):
    from itertools import combinations

    total = 0.0
    for n in range(1, order + 1):
        for a in combinations(range(len(s)), n):
            for b in combinations(range(len(t)), n):
                if all(s[i] == t[j] for i, j in zip(a, b)):
                    total += (1e-3 if n == 1 else 1.0) * decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_subsequence_kernel_equals_enumeration():
    marks = toxicity.Landmarks(["idiot", "scum", "loser"])
    units = ["idiot", "id.iot", "scam", "xyz", "closer", "é", "moron"]
    got = marks.kernel(units, all_pairs=True)
    for i, u in enumerate(units):
        for j, m in enumerate(marks.units):
            want = plain_kernel(u, m) / math.sqrt(plain_kernel(u, u) * plain_kernel(m, m))
            assert abs(got[i, j] - want ** toxicity.POWER) < 1e-4
    few = marks.kernel(units)
    assert (few[few > 0] == got[few > 0]).all() and few[3].sum() == 0 and few[1, 0] > 0
    assert toxicity.units_of(b"i d i o t x") == {"i", "d", "o", "t", "x", "idiotx"}
    assert toxicity.units_of(b"") == set() and all(len(u) <= 24 for u in toxicity.units_of(b"z" * 1000))


def test_toxicity_finds_held_out_insults(spark, documents):
    rng = random.Random(7)
    bad = ["grumbleton", "nastywort", "foulbeak"]
    rows, labels = [], []
    for i in range(900):
        words = [f"{rng.choice(['ba', 'lo', 'mi'])}{rng.choice(['ren', 'tas', 'dok'])}{rng.randrange(40)}" for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            word = rng.choice(bad)
            at = rng.randrange(1, len(word) - 1)
            words[rng.randrange(30)] = rng.choice([word, word, word[:at] + "." + word[at:], word.upper()])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "nothing here"), (2002, "foul" * 50_000)]
    marks = spark.createDataFrame([*labels, (3000, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_verdicts(documents(rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert sum(r.predicted for r in held if not truth[r.doc_id]) <= 0.02 * len(held)
    assert toxicity.toxicity_verdicts(documents([]), marks).count() == 0
    none = toxicity.toxicity_verdicts(documents(rows[:5]), marks.limit(0)).collect()
    assert [r.score for r in none] == [0.0] * 5


def plain_stats(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    inside = {j for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(inside)


def sentences(rng, n):
    return " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_quality_statistics_and_outliers(spark, documents):
    rng = random.Random(5)
    rows = [(i, sentences(rng, rng.randint(60, 400)), rng.choice(["en", "de"]), rng.choice(["a", "b"])) for i in range(500)]
    junk = [(1000 + i, " ".join(w + "$$$***" for w in sentences(rng, 150).split()), "en", "a") for i in range(25)]
    edge = [(2000, None), (2001, ""), (2002, "a b a b a b\na b\n\na b", None, None), (2003, " \x1c \t\n| x"),
            (2004, "é" * 300_000), (2005, "same word line " * 100), (None, sentences(rng, 80)), (1, rows[1][1], "en", "a")]
    docs = documents(rows + junk + edge)
    got = quality.quality_verdicts(docs).collect()
    want = sorted(((str(r[0]), *plain_stats(r[1])) for r in rows + junk + edge))
    assert sorted((str(r.doc_id), *(r[c] for c in quality.STATS)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id: r.kept for r in got}
    assert sum(kept[r[0]] for r in rows) >= 0.99 * len(rows)
    assert not any(kept[r[0]] for r in junk) and kept[2005] is False
    good = quality.keep_good(docs)
    assert good.columns == docs.columns
    assert sorted(str(r.doc_id) for r in good.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert quality.quality_verdicts(documents([])).count() == 0 and quality.keep_good(documents([])).count() == 0


def test_quality_judges_rows_of_small_languages(spark, documents):
    """Small languages, down to a single row, are judged by an estimate drawn toward that of all rows."""
    rng = random.Random(8)
    rows = [(i, sentences(rng, rng.randint(60, 400)), "en", "a") for i in range(150)]
    rows += [(200 + i, sentences(rng, rng.randint(60, 400)), rng.choice(["fr", "xx", None]), "a") for i in range(20)]
    odd = lambda: " ".join(w + "$$$***" for w in sentences(rng, 150).split())
    junk = [(300, odd(), "fr", "a"), (301, odd(), "??", "b"), (302, odd(), None, None)]
    got = {r.doc_id: r for r in quality.quality_verdicts(documents(rows + junk)).collect()}
    assert all(r.distance is not None for r in got.values())
    assert not any(got[r[0]].kept for r in junk) and sum(got[r[0]].kept for r in rows) >= 0.98 * len(rows)
    few = {r.doc_id: r.kept for r in quality.quality_verdicts(documents(rows[:40] + junk)).collect()}
    assert not any(few[r[0]] for r in junk) and all(few[r[0]] for r in rows[:40])
    kept = {r.doc_id for r in quality.keep_good(documents(rows + junk)).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_mahalanobis_distance_equals_numpy(spark):
    rng = np.random.default_rng(3)
    d = len(quality.FEATURES)
    x = rng.normal(size=(40, d))
    cov = np.cov(rng.normal(size=(200, d)).T) + np.eye(d)
    mean = rng.normal(size=d)
    row = {f"m{i}": float(mean[i]) for i in range(d)} | {f"c{i}{j}": float(cov[i, j]) for i in range(d) for j in range(i + 1)}
    est = quality._cholesky(spark.createDataFrame([row]), d)
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"x{i} double" for i in range(d))).crossJoin(est)
    got = [r[0] for r in df.select(quality._distance("x", "")).collect()]
    want = [float((v - mean) @ np.linalg.inv(cov) @ (v - mean)) for v in x]
    assert sorted(got) == pytest.approx(sorted(want))


def plain_steps(x, start, n_rows):
    """Concentration steps on exactly ``n_rows`` rows until they stay the same; half the log of the determinant, mean, rows."""
    near = start
    for _ in range(100):
        mean, cov = x[near].mean(0), np.cov(x[near].T, bias=True) + np.diag(np.square(quality.FLOORS))
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        new = np.sort(np.argsort(d2, kind="stable")[:n_rows])
        if np.array_equal(new, near):
            break
        near = new
    return 0.5 * np.linalg.slogdet(cov)[1], mean, near


@pytest.mark.parametrize("kind", ["far", "correlated"])
def test_fit_equals_a_search_from_many_starts(spark, kind):
    rng = np.random.default_rng(7)
    d = len(quality.FEATURES)
    good = rng.normal(size=(48, d))
    if kind == "correlated":
        good[:, 1] = 3 * good[:, 0] + 0.3 * good[:, 1]
        good[:, 0] *= 3
    x = np.vstack([good, rng.normal(size=(12, d)) * 0.5 + 8])
    tries = [plain_steps(x, rng.choice(60, d + 1, replace=False), 45) for _ in range(300)]
    want = min(tries, key=lambda t: t[0])
    rows = spark.createDataFrame([("en", "a", v.tolist()) for v in x], "lang string, source string, x array<double>")
    fitted = quality.fit(rows)
    got = fitted.collect()
    assert sorted(r.level for r in got) == [0, 1, 2] and {r.rows for r in got} == {60}
    top = next(r for r in got if r.level == 2)
    # the subset ends at the edge of a histogram's bin, so it may hold a row or two more
    assert top.log_det <= want[0] + 0.15
    assert max(abs(top[f"m{i}"] - want[1][i]) for i in range(d)) < 0.3
    for r in got:  # equal groups: shrinking one toward the other changes nothing
        assert max(abs(r[f"m{i}"] - top[f"m{i}"]) for i in range(d)) < 1e-9 and r.scale == pytest.approx(top.scale)
    judged = quality.judge(rows, fitted, [F.col("x")[i] for i in range(d)]).collect()
    assert all(r.outlier == (min(r.x) > 5) for r in judged)


def test_estimates_move_with_the_number_of_rows(spark):
    """A group's mean lies between its parent's and its own, nearer to its own the more rows it has; no size is a switch."""
    rng = np.random.default_rng(9)
    d = len(quality.FEATURES)
    rows = [("en", "big", rng.normal(size=d).tolist()) for _ in range(600)]
    for name, n in (("s10", 10), ("s99", 99), ("s101", 101), ("s300", 300)):
        rows += [("en", name, (rng.normal(size=d) * 0.2 + 2).tolist()) for _ in range(n)]
    fitted = quality.fit(spark.createDataFrame(rows, "lang string, source string, x array<double>")).collect()
    got = {r.source: r for r in fitted if r.level == 0}
    parent = next(r.m0 for r in fitted if r.level == 1)
    means = [got[n].m0 for n in ("s10", "s99", "s101", "s300")]
    assert means == sorted(means) and means[2] - means[1] < 0.1
    for m, n in zip(means, (10, 99, 101, 300), strict=True):  # the groups' own means are 2 but for chance
        assert abs(m - (n * 2 + 50 * parent) / (n + 50)) < 0.1
