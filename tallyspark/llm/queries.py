"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.bpe import bpe_decode, bpe_encode
from tallyspark.llm.exact_dedup import dedup_verdicts
from tallyspark.llm.heap_kmeans import cluster_vectors

from tallyspark.llm.jaccard_join import near_duplicates
from tallyspark.llm.merkle import document_manifest
from tallyspark.llm.minhash import minhash_duplicates
from tallyspark.llm.mixing import mix_counts
from tallyspark.llm.packing import pack
from tallyspark.llm.pii import KINDS, find_pii, listed
from tallyspark.llm.quality import quality_verdicts

from tallyspark.llm.substring_dedup import remove_repeats
from tallyspark.llm.text import small_batches

from tallyspark.llm.toxicity import toxicity_verdicts

from tallyspark.llm.url_filter import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    """Register a function under its name."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_verdicts(table(spark, sf_dir, "documents"))


SQL["op1_exact_dedup"] = r"""
WITH h AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h JOIN g USING (text_sha256)
"""


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe_decode(bpe_encode(docs).select("doc_id", "n_tokens", "ids"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL["op2_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL["op10_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS p FROM w
), x AS (SELECT g.doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM g JOIN w USING (doc_id)),
f AS (SELECT s, min(doc_id) AS lo FROM x GROUP BY s),
r AS (
  SELECT DISTINCT x.doc_id, unnest(generate_series(p, p + 12)) AS q FROM x JOIN f USING (s) WHERE x.doc_id > f.lo
), m AS (SELECT doc_id, list(q) AS q FROM r GROUP BY doc_id),
k AS (
  SELECT w.doc_id, w.w, coalesce(len(m.q), 0) AS gone,
         CASE WHEN m.q IS NULL THEN w.w
              ELSE list_filter(w.w, lambda v, i: NOT list_contains(m.q, i)) END AS kept
  FROM w LEFT JOIN m USING (doc_id)
)
SELECT doc_id, len(w)::BIGINT AS n_words, gone::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The rule list of op6 (fixed values): verdict, then host and begin of the path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        listed(F.concat("base", "added")).alias("spans"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("task", "row", "doc_ids", "starts", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2("positions", 256).alias("positions_sha256"))


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(table(spark, sf_dir, "documents"))


def _merkle_levels(nodes: str, out: str, levels: int) -> str:
    """CTEs of a tree's levels: ``nodes`` has tree, i, h, n; every level's runs of eight, until a tree has one node.

    ``out``_k holds level k, ``out``_p_k the siblings of its nodes, in order.
    """
    parts = [f"{out}_0 AS (SELECT tree, i, h, n FROM {nodes})"]
    for k in range(levels):
        parts.append(f"""{out}_g_{k} AS (
  SELECT tree, i // 8 AS i, (n + 7) // 8 AS n, list(h ORDER BY i) AS hs FROM {out}_{k} WHERE n > 1 GROUP BY tree, i // 8, n
), {out}_{k + 1} AS (SELECT tree, i, sha256(array_to_string(hs, '')) AS h, n FROM {out}_g_{k}
), {out}_p_{k} AS (
  SELECT tree, i * 8 + p - 1 AS i, array_to_string(hs[1:p - 1], '') AS l, array_to_string(hs[p + 1:], '') AS r
  FROM (SELECT tree, i, hs, unnest(generate_series(1, len(hs))) AS p FROM {out}_g_{k}))""")
    return ",\n".join(parts)


def _merkle_sql(levels: int = 7, above: int = 3) -> str:
    """The manifest in SQL, for up to 8**levels documents of a language and 8**above languages.

    CRC-32 is its definition: each byte is xored into the low bits, then eight shifts follow.
    """
    field = ("CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END")
    names = ["doc_id", "source", "lang", "n_chars"]
    head = " || ".join(field.format(c) for c in names)
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    joins, proof, fold = [], [], "f0"
    folds = ["CASE WHEN mod(crc, 3) = 0 THEN changed ELSE leaf END AS f0"]
    for k in range(levels):
        joins.append(f"LEFT JOIN t_p_{k} a{k} ON a{k}.tree = d.tree AND a{k}.i = d.i // {8 ** k}")
        proof.append(f"coalesce(a{k}.l || a{k}.r, '')")
        folds.append(f"CASE WHEN a{k}.l IS NULL THEN {fold} ELSE sha256(a{k}.l || {fold} || a{k}.r) END AS f{k + 1}")
        fold = f"f{k + 1}"
    for k in range(above):
        joins.append(f"LEFT JOIN u_p_{k} b{k} ON b{k}.i = s.i // {8 ** k}")
        proof.append(f"coalesce(b{k}.l || b{k}.r, '')")
        folds.append(f"CASE WHEN b{k}.l IS NULL THEN {fold} ELSE sha256(b{k}.l || {fold} || b{k}.r) END AS g{k + 1}")
        fold = f"g{k + 1}"
    return f"""
WITH RECURSIVE e AS (
  SELECT *, coalesce('=' || lang, '') AS tree, sha256({head} || {field.format("text")}) AS leaf,
         sha256({head} || {field.format(low)}) AS changed, doc_id::VARCHAR AS id FROM documents
), c AS (
  SELECT DISTINCT id, 0 AS step, 4294967295::BIGINT AS crc FROM e
  UNION ALL
  SELECT id, step + 1, CASE WHEN step % 9 = 0 THEN xor(crc, ascii(id[step // 9 + 1])::BIGINT)
                          ELSE xor(crc // 2, CASE WHEN crc % 2 = 1 THEN 3988292384 ELSE 0 END) END
  FROM c WHERE step < 9 * length(id)
), d AS (
  SELECT e.*, xor(c.crc, 4294967295) AS crc, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY tree) AS n
  FROM e LEFT JOIN c ON c.id = e.id AND c.step = 9 * length(c.id)
), x AS (SELECT tree, i, leaf AS h, n FROM d),
{_merkle_levels("x", "t", levels)},
s AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n
  FROM ({" UNION ALL ".join(f"SELECT tree, h FROM t_{k} WHERE n = 1" for k in range(levels + 1))})
), y AS (SELECT '' AS tree, i, h, n FROM s),
{_merkle_levels("y", "u", above)},
o AS ({" UNION ALL ".join(f"SELECT h FROM u_{k} WHERE n = 1" for k in range(above + 1))}),
z AS (
  SELECT d.doc_id, d.leaf, s.h AS subroot, o.h AS root, sha256({" || ".join(proof)}) AS proof_sha256, {", ".join(folds)}
  FROM d JOIN s ON s.tree = d.tree JOIN o ON true {" ".join(joins)}
)
SELECT doc_id, leaf, subroot, root, proof_sha256, {fold} AS folded_root, {fold} = root AS verified FROM z
"""


SQL["op11_merkle"] = _merkle_sql()


@query
def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_duplicates(table(spark, sf_dir, "documents"))


SQL["op12_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""


@query
def op13_heap_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _kmeans_sql(dim: int = 64, k: int = 8, rounds: int = 10) -> str:
    """The plain algorithm, one CTE a step: every vector against every centroid."""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, e FROM v ORDER BY c LIMIT {k}
)"""]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (
  SELECT v.r, c.c, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
  FROM v CROSS JOIN c{i} c
), a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY r)""")
        if i < rounds:
            parts.append(f"""m{i} AS (
  SELECT a.c, v.r, unnest(v.e) AS x, unnest(generate_series(1, {dim})) AS j FROM a{i} a JOIN v USING (r)
), f{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM m{i} GROUP BY c, j),
c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(n.e, c.e) AS e FROM c{i} c LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS e FROM f{i} GROUP BY c) n USING (c)
)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
       sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c USING (c)
"""


SQL["op13_heap_kmeans"] = _kmeans_sql()
