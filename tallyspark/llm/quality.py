"""Operator 9, quality rules: base rules and robust multivariate outliers (DataFrame functions only).

Every text becomes a vector of transformed statistics.  For each language and
source, each language and all rows a minimum-covariance-determinant estimate is
found by concentration steps: the mean and covariance of the ``share`` of rows
that lie nearest give new distances, and so on.  Three starts (medians and
deviations with no correlation, with that of squashed values, with that of
spatial signs) take two steps each; in every group the one with the smallest
determinant goes on until no determinant falls any more.  An estimate from n
rows is shrunk toward that of its language, and this toward that of all rows, by
n / (n + ``prior_rows``), so small groups have one too.  Rows whose squared
Mahalanobis distance exceeds the cutoff are rejected.

The estimates come from all rows.  Each step is one grouped sum and one grouped
histogram of distances, both partial before the shuffle, so a source with a
third of all rows costs no task more than another; only the small tables of
estimates are joined to the rows.

Defined cases: a null text has no words and fails the base rules; null
languages and sources are groups of their own; very long texts are read whole;
repeated rows count, and are judged, each for itself; other columns, of any type
or name, are untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.text import SPACE
from tallyspark.session import drop_scratch, store

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
FEATURES = ["log_words", "word_length", "symbol_rate", "dup_lines", "repeat_rate"]
#: Least standard deviations, in the features' units: finer spreads are not told apart.
FLOORS = [0.5, 0.15, 0.25, 0.5, 0.25]
#: The chi-square median for as many degrees of freedom as features (fixed value).
CHI2_MEDIAN = 4.351
BINS_PER_OCTAVE = 32
KEYS = ["lang", "source", "level"]
#: The chi-square quantile of 0.99999 for as many degrees of freedom as features (fixed value).
CUTOFF = 30.86
#: Tables of estimates with at most so many rows are sent to the rows they meet; Spark chooses the join of longer ones.
SENT = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def repeat_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text, the first included.

    Windows are sorted by hash, so equal ones are neighbours; the begins of
    repeated ones, in text order, cover up to ``width`` words each.
    """
    def window(w: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(*[F.get(w, i + F.lit(k)) for k in range(width)]).alias("h"), i.alias("p"))

    def begins(s: Column) -> Column:
        same = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["p"]))

    def covered(r: Column) -> Column:
        gaps = F.transform(r, lambda x, i: F.coalesce(F.least(F.get(r, i + 1) - x, F.lit(width)), F.lit(width)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def count(w: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(width)), lambda i: window(w, i))
        return F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(
            let(F.sort_array(some), lambda s: let(begins(s), covered)))

    return let(words, count)


def _length_without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus a struct column ``stats`` of the five counts (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: _length_without(x, BLANKS) > 0)
    return docs.withColumn("stats", let(words_of(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _length_without(t, BLANKS).cast("long").alias("word_chars"),
        (F.length(t) - _length_without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"))))


def base_failed(s: str = "stats") -> Column:
    return (F.col(f"{s}.n_words") < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * F.col(f"{s}.n_words"))


def features(s: str = "stats") -> list[Column]:
    """The transformed statistics, in the order of FEATURES."""
    n = F.greatest(F.col(f"{s}.n_words"), F.lit(1)).cast("double")
    return [F.log(n), F.log((F.col(f"{s}.word_chars") + 1) / n),
            F.log1p(10 * F.col(f"{s}.n_symbols") / n),
            F.log1p(F.col(f"{s}.n_dup_lines").cast("double")),
            F.log1p(5 * F.col(f"{s}.n_repeat_words") / n)]


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _grouped(rows: DataFrame, d2: Column, share: float, name: str, keys: list[str]) -> DataFrame:
    """Per group, the upper edge of the histogram bin within which ``share`` of the distances lie."""
    octave = F.floor(F.log2(d2 + F.lit(2.0 ** -20)) * BINS_PER_OCTAVE)
    bins = rows.groupBy(*keys, octave.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*keys)
    run = bins.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "all": F.sum("n").over(group)})
    return (run.filter(F.col("upto") >= F.col("all") * share).groupBy(*keys)
            .agg(F.pow(F.lit(2.0), (F.min("bin") + 1) / F.lit(float(BINS_PER_OCTAVE))).alias(name)))


def _distance(x: str, e: str) -> Column:
    """Squared Mahalanobis distance of columns {x}0, {x}1, ... by the inverse w of the Cholesky factor; ``e``: its prefix."""
    rows = [" + ".join(f"{e}w{i}{j} * ({x}{j} - {e}m{j})" for j in range(i + 1)) for i in range(len(FEATURES))]
    return F.expr(" + ".join(f"pow({r}, 2)" for r in rows))


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}")) for c in keys])


def _sent(table: DataFrame, few: bool) -> DataFrame:
    """``table``, broadcast where it is short: its many small files look large to Spark, which then would shuffle the rows."""
    return F.broadcast(table) if few else table


def _join(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """Every row with the estimates of its groups, one for each start."""
    e = estimates.select(*[F.col(c).alias(f"e_{c}") for c in estimates.columns])
    return rows.join(_sent(e, few), _same("", "e_", KEYS))


def _cholesky(estimates: DataFrame, d: int) -> DataFrame:
    """Columns l{i}{j} of the lower factor from the covariances c{i}{j}, and w{i}{j} of its inverse."""
    for j in range(d):
        def less(i: int, j: int = j) -> str:
            return "".join([f"c{i}{j}", *[f" - l{i}{k} * l{j}{k}" for k in range(j)]])

        estimates = estimates.selectExpr("*", f"sqrt(greatest({less(j)}, 1e-9D)) AS l{j}{j}")
        if j + 1 < d:
            estimates = estimates.selectExpr("*", *[f"({less(i)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, d)])
    for i in range(d):
        sums = [" - ".join(["0D", *[f"l{i}{k} * w{k}{j}" for k in range(j, i)]]) for j in range(i)]
        estimates = estimates.selectExpr("*", *[f"({r}) / l{i}{i} AS w{i}{j}" for j, r in enumerate(sums)], f"1D / l{i}{i} AS w{i}{i}")
    return estimates


def _log_det(d: int, prefix: str = "") -> Column:
    """Half the logarithm of the covariance's determinant."""
    return F.expr(" + ".join(f"ln({prefix}l{i}{i})" for i in range(d)))


def _starts(rows: DataFrame, d: int, paths: list[str]) -> tuple[DataFrame, bool]:
    """Three estimates a group: medians, absolute deviations and the correlations of start 0, 1 or 2; whether they are few."""
    middle, path = store(rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"), *[F.expr(f"percentile_approx(round(x{i}, 4), 0.5) AS m{i}") for i in range(d)]), "mcd")
    paths.append(path)
    few = 3 * middle.count() <= SENT
    spread = _join(rows, middle, few).groupBy(*KEYS).agg(
        *[F.expr(f"percentile_approx(round(abs(x{i} - e_m{i}), 4), 0.5) AS s{i}") for i in range(d)])
    scaled, path = store(_sent(middle, few).alias("a").join(spread.alias("b"), _same("a.", "b.", KEYS)).selectExpr(
        "a.*", *[f"greatest(1.4826D * s{i}, double({FLOORS[i]})) AS s{i}" for i in range(d)]), "mcd")
    paths.append(path)

    z = _join(rows, scaled, few).selectExpr(*KEYS, *[f"(x{i} - e_m{i}) / e_s{i} AS z{i}" for i in range(d)])
    z = z.selectExpr("*", "greatest(sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(d)) + "), 1e-9D) AS norm")
    squashed = {1: "tanh(z{0})", 2: "z{0} / norm"}
    related = z.groupBy(*KEYS).agg(*[F.expr(f"covar_pop({k.format(i)}, {k.format(j)}) AS r{n}_{i}{j}")
                                     for n, k in squashed.items() for i in range(d) for j in range(i + 1)])

    def covariance(n: int, i: int, j: int) -> str:
        # correlations are damped a little, so that the matrix keeps an inverse; a constant statistic has none
        both = f"s{i} * s{j}"
        if i == j or not n:
            return both if i == j else "0D"
        return f"{both} * 0.95D * coalesce(try_divide(r{n}_{i}{j}, sqrt(r{n}_{i}{i} * r{n}_{j}{j})), 0D)"

    each = ", ".join("struct(" + ", ".join([f"{n} AS start", *[f"{covariance(n, i, j)} AS c{i}{j}" for i in range(d) for j in range(i + 1)]])
                     + ")" for n in range(3))
    begun = _sent(scaled, few).alias("a").join(related.alias("b"), _same("a.", "b.", KEYS)).selectExpr(
        *[f"a.{c}" for c in KEYS], "rows", *[f"m{i}" for i in range(d)], f"inline(array({each}))")
    started, path = store(_cholesky(begun, d), "mcd")
    paths.append(path)
    return started, few


def _concentrate(rows: DataFrame, estimates: DataFrame, d: int, share: float, few: bool, paths: list[str]) -> DataFrame:
    """One concentration step of every group and start; ``fell`` is by how much half the determinant's logarithm fell."""
    keys = [*KEYS, "start"]
    near = _join(rows, estimates, few).select(*KEYS, F.col("e_start").alias("start"), _distance("x", "e_").alias("d2"))
    both = _keyed(estimates, _grouped(near, F.col("d2"), share, "cut", keys), keys, few)
    near = _join(rows, both, few).withColumn("start", F.col("e_start")).filter(_distance("x", "e_") <= F.col("e_cut"))
    lower = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = near.groupBy(*keys).agg(
        F.first("e_rows").alias("rows"), F.first(_log_det(d, "e_")).alias("before"), *[F.expr(f"avg(x{i}) AS m{i}") for i in range(d)],
        *[F.expr(f"covar_pop(x{i}, x{j}) AS p{i}{j}") for i, j in lower])
    sums = sums.selectExpr(*keys, "rows", "before", *[f"m{i}" for i in range(d)],
                           *[f"p{i}{j} + double({FLOORS[i] ** 2 if i == j else 0.0}) AS c{i}{j}" for i, j in lower])
    new, path = store(_cholesky(sums, d).withColumn("fell", F.col("before") - _log_det(d)).drop("before"), "mcd")
    paths.append(path)
    return new


def _shrunk(estimates: DataFrame, values: list[str], prior_rows: float, few: bool) -> DataFrame:
    """KEYS, rows and ``values`` moved toward the language's own ones, and these toward those of all rows, by n / (n + prior_rows)."""
    def toward(level: int, parent: DataFrame, same: Column) -> DataFrame:
        moved = [f"(a.rows * a.{v} + {float(prior_rows)}D * b.{v}) / (a.rows + {float(prior_rows)}D) AS {v}" for v in values]
        return estimates.filter(F.col("level") == level).alias("a").join(_sent(parent, few).alias("b"), same).selectExpr(
            *[f"a.{c}" for c in KEYS], "a.rows", *moved)

    top = estimates.filter("level = 2").select(*KEYS, "rows", *values)
    langs = toward(1, top, F.col("b.level") == F.col("a.level") + 1)
    return top.unionByName(langs).unionByName(toward(0, langs, F.col("a.lang").eqNullSafe(F.col("b.lang"))))


def fit(stats: DataFrame, share: float = 0.75, prior_rows: float = 50.0, most_steps: int = 8) -> DataFrame:
    """Estimates by (lang, source, level): level 0 a language's source, level 1 the whole language, level 2 all rows.

    ``stats`` has lang, source, x (array of features).  Rows that fail the base
    rules should be left out.  ``rows`` tells a group's rows, ``log_det`` half
    the logarithm of the determinant its own rows gave, ``scale`` the factor that
    makes the distances of normal rows those of a chi-square variable.
    """
    d = len(FEATURES)
    none = F.lit(None).cast("string")
    levels = F.array(*[F.struct(lang.alias("lang"), source.alias("source"), F.lit(i).alias("level"))
                       for i, (lang, source) in enumerate([(F.col("lang"), F.col("source")), (F.col("lang"), none), (none, none)])])
    rows = stats.select("x", F.explode(levels).alias("g")).select(
        "g.lang", "g.source", "g.level", *[F.col("x")[i].alias(f"x{i}") for i in range(d)])
    paths: list[str] = []

    estimates, few = _starts(rows, d, paths)
    for _ in range(2):
        estimates = _concentrate(rows, estimates, d, share, few, paths)
    # the start with the smallest determinant goes on; of equal ones the first
    best = F.struct(F.round(_log_det(d), 6).alias("log_det"), F.col("start"))
    least = estimates.groupBy(*KEYS).agg(F.min(best).alias("best"))
    estimates, path = store(_sent(estimates, few).alias("a").join(
        least.alias("b"), _same("a.", "b.", KEYS) & (F.col("a.start") == F.col("b.best.start"))).select("a.*"), "mcd")
    paths.append(path)
    for _ in range(most_steps - 2):
        if (estimates.agg(F.max("fell")).first()[0] or 0.0) < 0.01:
            break
        estimates = _concentrate(rows, estimates, d, share, few, paths)

    own = estimates.select(*KEYS, _log_det(d).alias("log_det"))
    moments = [*[f"m{i}" for i in range(d)], *[f"c{i}{j}" for i in range(d) for j in range(i + 1)]]
    shrunk, path = store(_cholesky(_shrunk(estimates, moments, prior_rows, few), d), "mcd")
    paths.append(path)
    near = _join(rows, shrunk, few).select(*KEYS, _distance("x", "e_").alias("d2"))
    cut = _grouped(near, F.col("d2"), 0.5, "cut", KEYS)
    log_scale = F.log(F.greatest(F.col("cut") / CHI2_MEDIAN, F.lit(1.0)))
    scaled, path = store(_keyed(shrunk, cut, KEYS, few).withColumn("log_scale", log_scale), "mcd")  # read for every level
    paths.append(path)
    scales = _shrunk(scaled, ["log_scale"], prior_rows, few)
    final = shrunk.alias("a").join(_sent(scales, few).alias("s"), _same("a.", "s.", KEYS)).join(
        _sent(own, few).alias("o"), _same("a.", "o.", KEYS))
    estimates, path = store(final.select("a.*", F.exp("s.log_scale").alias("scale"), "o.log_det"), "mcd")
    for old in paths:
        drop_scratch(stats.sparkSession, old)
    return estimates


def _keyed(estimates: DataFrame, cut: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """``estimates`` with the column ``cut`` of the same group."""
    return _sent(estimates, few).alias("a").join(cut.alias("b"), _same("a.", "b.", keys)).select("a.*", "b.cut")


def judge(rows: DataFrame, estimates: DataFrame, x: list[Column], cutoff: float = CUTOFF) -> DataFrame:
    """``rows`` (with lang and source) plus ``outlier``: the distance in the row's own group, else language, else in all rows."""
    d = len(FEATURES)
    few = estimates.count() <= SENT
    fields = ["scale", *[f"m{i}" for i in range(d)], *[f"w{i}{j}" for i in range(d) for j in range(i + 1)]]
    packed = F.struct(*[F.col(c) for c in fields])
    own = estimates.filter("level = 0").select(F.col("lang").alias("_l0"), F.col("source").alias("_s0"), packed.alias("_e0"))
    wide = estimates.filter("level = 1").select(F.col("lang").alias("_l1"), packed.alias("_e1"))
    out = rows.join(_sent(own, few), F.col("lang").eqNullSafe(F.col("_l0")) & F.col("source").eqNullSafe(F.col("_s0")), "left")
    last = estimates.filter("level = 2").select(*fields).first()  # the one row over all rows; none without sound rows
    every = [F.struct(*[F.lit(last[c]).alias(c) for c in fields])] if last else []
    out = out.join(_sent(wide, few), F.col("lang").eqNullSafe(F.col("_l1")), "left").withColumn("_e", F.coalesce("_e0", "_e1", *every))
    out = out.withColumns({f"_x{i}": v for i, v in enumerate(x)}).withColumn("distance", _distance("_x", "_e.") / F.col("_e.scale"))
    return out.withColumn("outlier", F.coalesce(F.col("distance") > cutoff, F.lit(False))).drop(
        "_l0", "_s0", "_e0", "_l1", "_e1", "_e", *[f"_x{i}" for i in range(d)])


def quality_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                     source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the five counts, base_failed, distance and kept, one row per document; the text is read once."""
    rows = with_stats(docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"),
                                  F.col(source).cast("string").alias("source"), F.col(text).alias("text")))
    stats, _ = store(rows.select("doc_id", "lang", "source", "stats"), "stats")
    sound = stats.filter(~base_failed()).select("lang", "source", F.array(*features()).alias("x"))
    judged = judge(stats, fit(sound), features(), cutoff)
    return judged.select("doc_id", "stats.*", base_failed().alias("base_failed"), "distance",
                         (~base_failed() & ~F.col("outlier")).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
              cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were.

    The estimates are small, so the rows meet them without moving the texts.
    """
    at = docs.columns.index
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    rows = with_stats(docs.select(row), f"row.c{at(text)}").select(
        "row", F.col(f"row.c{at(lang)}").cast("string").alias("lang"), F.col(f"row.c{at(source)}").cast("string").alias("source"),
        "stats")
    # rows and statistics are stored once: the estimates read the statistics alone, the verdicts need no second count
    counted, path = store(rows.filter(~base_failed()), "counted")
    estimates = fit(counted.select("lang", "source", F.array(*features()).alias("x")))
    good = judge(counted, estimates, features(), cutoff).filter("NOT outlier")
    return good.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
