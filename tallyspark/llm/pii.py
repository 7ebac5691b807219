"""Operator 7, PII: candidates judged by gradient boosting, beside fixed patterns (DataFrame functions only).

Base patterns (email, ip, card, phone) give the spans that always count.  Two
high-recall generators propose further, overlapping spans: anything built like
an address around an at sign, and runs of digits with separators.  Trees see a
candidate's format and context with the base patterns' deciding marks hidden (the
at sign's spelling, '+' and the country code, check digits), so what they learn
from confirmed candidates also holds for those that the base patterns cannot
match.  They learn from all documents, alike examples as one weighted row.  Against
confirmed candidates stand those that the base patterns reject and, for addresses,
two neighbouring words of each text with the blank hidden likewise.  No examples, for or against,
are candidates on which the base patterns say nothing: addresses spelled without
an at sign, and formatted numbers without '+' whose masked format is confirmed in
a share of ``shaped`` of its cases at least.  For each generator a threshold
calibrated for ``precision`` on held-out examples selects those to add.  The trees
are part of the expression: scoring is one scan of the texts without a join,
shuffle or Python.

Positions come from the lengths of matches and of the gaps between them.  All
patterns are written so that a text of n characters takes O(n) steps.

Defined cases: a null text is empty and has no spans; repeated rows are judged
alike; without confirmed and unconfirmed candidates nothing is added; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.boosted import BoostedTrees, train
from tallyspark.llm.quality import let
from tallyspark.session import drop_scratch, store

KINDS = ("email", "ip", "card", "phone")
#: The base patterns with atomic repeats and begins, so that no scan is repeated; what they match is the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates, by the kind that their spans get.
GENERATORS = {
    "address": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9.-]++",
    "number": r"(?:(?<![0-9+(])|\G)[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9])++",
}
#: Neighbouring words: what an address with a hidden at sign is told from.  Only examples for the trees.
WORDS = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20[A-Za-z0-9.-]++"
#: What a text must hold to have a match at all: most texts lack it, and their long scans are skipped.
NEEDED = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]",
          "address": "@|[(\\[]at[)\\]]", "number": "[0-9]", "words": "\\x20"}
CONTEXT = 24
#: Positions are summed up in runs of so many matches, so that many matches in a text take few steps.
RUN = 256
CUES = r"(?i)mail|contact|tel|phone|call|fax|mobile|card|visa|account|iban|address|\bip\b|host|server|login"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(2 * d > 9, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(
            F.regexp_replace(p, "^0+", ""),
            lambda q: (F.length(q) <= 3) & (F.coalesce(F.substring(q, 1, 3).try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "number":
        return F.length(_digits(m)) >= 7
    return F.lit(True)


def spans_of(text: Column, kind: str, pattern: str, order: int) -> Column:
    """The valid matches of a pattern as an array of (start, rank, end, kind), in text order."""
    whole = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    plus = lambda a, b: a + b

    def ends(steps: Column) -> Column:
        """Running sums of an array, over blocks and inside them."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")),
                             lambda b: F.slice(steps, b * RUN + 1, F.lit(RUN)))

        def run(block: Column, before: Column) -> Column:
            return F.transform(block, lambda _, j: before + F.aggregate(F.slice(block, F.lit(1), j + 1), F.lit(0), plus))

        def over(bs: Column) -> Column:
            sums = F.transform(bs, lambda x: F.aggregate(x, F.lit(0), plus))
            return let(sums, lambda s: F.flatten(F.transform(bs, lambda x, b: let(
                F.aggregate(F.slice(s, F.lit(1), b), F.lit(0), plus), lambda before: run(x, before)))))

        return let(blocks, over)

    def located(w: Column) -> Column:
        steps = F.transform(w["m"], lambda x, i: F.length(x) + F.length(F.get(w["g"], i)))
        placed = let(steps, lambda p: let(ends(p), lambda e: F.transform(w["m"], lambda x, i: F.struct(
            (F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("m")))))
        valid = F.filter(placed, lambda x: _valid(kind, x["m"]))
        found = F.transform(valid, lambda x: F.struct(
            x["start"].alias("start"), F.lit(order).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))
        return F.when(F.size(w["m"]) == 0, empty).otherwise(found)

    return F.when(text.rlike(NEEDED[kind]), let(whole, located)).otherwise(empty)


def base_spans(text: Column) -> Column:
    found = [spans_of(text, k, PATTERNS[k], i) for i, k in enumerate(KINDS)]
    return F.sort_array(F.concat(*found))


def candidate_spans(text: Column) -> Column:
    found = [spans_of(text, k, p, len(KINDS) + i) for i, (k, p) in enumerate(GENERATORS.items())]
    return F.sort_array(F.concat(*found))


def _count(m: Column, letters: str) -> Column:
    return (F.length(m) - F.length(F.translate(m, letters, ""))).cast("double")


def masked(m: Column, kind: Column) -> Column:
    """A candidate with the deciding marks hidden: one spelling of the at sign, no '+' and country code before a separator."""
    at = F.regexp_replace(m, r"\x20?[(\[]at[)\]]\x20?|\x20|@", "@")
    code = F.regexp_replace(m, r"^(?:(?:\+[0-9]{1,3}|1)(?:[\x20.\-/]++|(?=\()))|^\+", "")
    return F.when(kind == "number", code).otherwise(at)


def candidate_features(text: Column, s: Column) -> Column:
    """Masked format and context of a candidate, as an array of doubles."""
    m = F.substring(text, s["start"] + 1, s["end"] - s["start"])
    begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
    before = F.substring(text, begin + 1, s["start"] - begin)
    after = F.substring(text, s["end"] + 1, F.lit(CONTEXT))

    def build(x: Column) -> Column:
        m, before, after = x["m"], x["before"], x["after"]
        n = F.when(s["kind"] == "number", m).otherwise("")
        domain = F.when(s["kind"] == "number", "").otherwise(F.substring_index(m, "@", -1))
        groups = F.filter(F.split(n, "[^0-9]+"), lambda g: g != "")
        size = lambda k: F.coalesce(F.length(F.get(groups, F.size(groups) - k)), F.lit(0)).cast("double")
        return F.array(
            (s["kind"] == "number").cast("double"), F.length(_digits(n)).cast("double"),
            F.size(groups).cast("double"), size(1), size(2), size(3),
            F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
            _count(n, "."), _count(n, "-"), _count(n, " "), _count(n, "()"), _count(n, "/"),
            domain.rlike(r"^[A-Za-z0-9-]+\.[A-Za-z0-9]").cast("double"),
            domain.rlike(r"[A-Za-z0-9]\.[A-Za-z]{2,}\.?$").cast("double"),
            before.rlike(CUES).cast("double"), before.rlike(r"[0-9][\x20,;|]*$").cast("double"),
            before.rlike(r"[A-Za-z]$").cast("double"), after.rlike(r"^[\x20,;|]*[0-9]").cast("double"),
            after.rlike("^[A-Za-z@]").cast("double"))

    return let(F.struct(masked(m, s["kind"]).alias("m"), before.alias("before"), after.alias("after")), build)


def _meets(s: Column, others: Column) -> Column:
    return F.exists(others, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def _examples(t: Column, base: Column, hashed: Column) -> Column:
    """A text's examples as an array of (span, label, shape).

    Label 1 is confirmed, 0 is not, null an address without an at sign.  Numbers
    that the base patterns may decide have no shape, the others that of their masked format.
    """
    def label(s: Column) -> Column:
        # an ip needs no masked likeness: all of its forms are in the base pattern
        inside = F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]) & (b["kind"] != "ip"))
        number = s["kind"] == "number"

        def build(m: Column) -> Column:
            form = masked(m, s["kind"])
            free = number & form.rlike("[^0-9]") & (inside | ~(
                m.startswith("+") | (F.length(_digits(m)).between(12, 19) & m.rlike(r"^[0-9](?:[\x20-]?[0-9])++$"))))
            return F.struct(s.alias("s"), F.when(number | m.contains("@"), inside.cast("int")).alias("label"),
                            F.when(free, F.xxhash64(F.regexp_replace(form, "[0-9]", "0"))).alias("shape"))

        return let(F.substring(t, s["start"] + 1, s["end"] - s["start"]), build)

    def one(words: Column) -> Column:
        apart = F.filter(words, lambda s: ~_meets(s, base))
        return let(apart, lambda a: F.slice(a, F.pmod(hashed, F.greatest(F.size(a), F.lit(1))).cast("int") + 1, F.lit(1)))

    words = spans_of(t, "words", WORDS, len(KINDS) + len(GENERATORS))
    return F.concat(F.transform(candidate_spans(t), label),
                    F.transform(one(words), lambda s: F.struct(
                        s.alias("s"), F.lit(0).alias("label"), F.lit(None).cast("long").alias("shape"))))


def example_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(fold, x, kind, label, shape, n): how many examples of all ``docs`` are alike, copies of one text in the same fold."""
    t = F.coalesce(F.col(text), F.lit(""))
    hashed = F.pmod(F.xxhash64(F.col(text), F.lit(11)), F.lit(1 << 30))
    rows = docs.select(t.alias("t"), hashed.alias("h")).select("t", "h", base_spans(F.col("t")).alias("base"))
    found = rows.select("h", F.explode(F.transform(_examples(F.col("t"), F.col("base"), F.col("h")), lambda e: F.struct(
        candidate_features(F.col("t"), e["s"]).alias("x"),
        F.when(e["s"]["kind"] == "number", "number").otherwise("address").alias("kind"), e["label"].alias("label"),
        e["shape"].alias("shape")))).alias("c")).select((F.col("h") % 4).alias("fold"), "c.*").filter("label IS NOT NULL")
    return found.groupBy("fold", "x", "kind", "label", "shape").agg(F.count(F.lit(1)).alias("n"))


def train_pii(docs: DataFrame, text: str = "text", precision: float = 0.98,
              shaped: float = 0.1) -> tuple[BoostedTrees, dict[str, float]] | None:
    """Trees, and thresholds by generator, from the examples of all ``docs``; None if one label is missing.

    Alike examples are one weighted row, so the trees meet every example and
    hold only the different ones; copies of one text are in the same fold.
    """
    spark = docs.sparkSession
    stored, path = store(example_groups(docs, text), "candidates")
    known = stored.filter("shape IS NOT NULL").groupBy("shape").agg(
        (F.sum(F.col("label") * F.col("n")) / F.sum("n")).alias("share")).filter(
        F.col("share") >= shaped).select("shape", F.lit(True).alias("known"))
    labelled, labelled_path = store(stored.join(known, "shape", "left").filter("label = 1 OR known IS NULL").groupBy(
        "fold", "x", "kind", "label").agg(F.sum("n").alias("n")), "examples")
    drop_scratch(spark, path)
    learnt = labelled.filter("fold <> 0")
    trees = train(learnt, parts=max(4, learnt.count() // 100_000), weight="n")
    bins = []
    if trees is not None:
        scored = labelled.filter("fold = 0").select("kind", "label", "n", F.round(_chance(trees, F.col("x")), 2).alias("p"))
        bins = scored.groupBy("kind", "p").agg(F.sum(F.col("label") * F.col("n")).alias("ones"), F.sum("n").alias("n")).orderBy(
            F.desc("p")).collect()  # a hundred bins for each generator at most
    drop_scratch(spark, labelled_path)
    if trees is None:
        return None
    thresholds = dict.fromkeys(GENERATORS, 1.01)
    for kind in GENERATORS:
        ones, rows_ = 0, 0
        for r in (b for b in bins if b.kind == kind):
            ones, rows_ = ones + r.ones, rows_ + r.n
            if ones / rows_ >= precision:
                thresholds[kind] = r.p
    return trees, thresholds


def _chance(trees: BoostedTrees, x: Column) -> Column:
    return let(x, lambda f: trees.probability(lambda i: F.get(f, F.lit(i))))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, base (array of spans) and added (spans the method adds beside them), in one scan."""
    model = train_pii(docs, text, **options)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"))
    rows = rows.select("doc_id", "t", base_spans(F.col("t")).alias("base"))
    if model is None:
        return rows.select("doc_id", "base", F.slice("base", 1, 0).alias("added"))
    trees, thresholds = model

    def likely(s: Column) -> Column:
        least = F.when(s["kind"] == "number", thresholds["number"]).otherwise(thresholds["address"])
        chance = F.round(_chance(trees, candidate_features(F.col("t"), s)), 2)
        return F.when(_meets(s, F.col("base")), False).otherwise(chance >= least)

    return rows.select("doc_id", "base", F.filter(candidate_spans(F.col("t")), likely).alias("added"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end by start, then kind."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[PII]", **options) -> DataFrame:
    """doc_id and the text with every span replaced by ``mark`` (overlapping spans by one)."""
    found = find_pii(docs, doc_id, text, **options).select("doc_id", F.sort_array(F.concat("base", "added")).alias("s"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(found, "doc_id")

    def cut(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        gap = F.substring("text", acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(new, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("s", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda a: F.concat(
        a["out"], F.substring(F.coalesce("text", F.lit("")), a["at"] + 1, F.length(F.coalesce("text", F.lit(""))))))
    return rows.select("doc_id", done.alias("text"))
