"""The registered queries on the smallest tables: names, types, digests computed again in plain Python or by their SQL."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from test_filters import plain_spans
from tokenizers import Tokenizer

from tallyspark.llm.packing import LENGTH, pack, write_matrix
from tallyspark.llm.queries import QUERIES, SQL, URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def u4(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def texts(sf_small):
    rows = pq.read_table(f"{sf_small}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in rows}


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.no_truncation()
    own.no_padding()
    return own


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op10_substring_dedup", "op11_merkle"])
def test_queries_equal_their_sql(spark, sf_small, name):
    got = QUERIES[name](spark, sf_small).toArrow().to_pydict()
    db = duckdb.connect()
    for path in Path(sf_small).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = db.execute(SQL[name]).to_arrow_table().to_pydict()
    assert sorted(got) == sorted(want)
    rows = [sorted(zip(*(t[c] for c in sorted(t)), strict=True), key=str) for t in (got, want)]
    assert rows[0] == rows[1]


def test_op3_rows_hold_whole_documents(spark, sf_small, texts, library, tmp_path):
    end = library.token_to_id("<|endoftext|>")
    ids = {i: [*library.encode(r["text"] or "", add_special_tokens=False).ids, end] for i, r in texts.items()}
    packed = QUERIES["op3_packing"](spark, sf_small)
    assert dict(packed.dtypes) == {
        "task": "int", "row": "bigint", "doc_ids": "array<bigint>", "starts": "array<bigint>", "cu_seqlens": "array<int>",
        "ids_sha256": "string", "positions_sha256": "string"}
    seen = {i: 0 for i in ids}
    for r in packed.collect():
        row, places = [], []
        for d, s, a, z in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            row += ids[d][s:s + z - a]
            places += range(z - a)
            seen[d] += z - a
        pad = LENGTH - len(row)
        assert r.ids_sha256 == sha(u4(row + [end] * pad)) and r.positions_sha256 == sha(u4([*places, *range(pad)]))
    assert seen == {i: len(x) for i, x in ids.items()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    write_matrix(pack(docs, length=256), str(tmp_path / "matrix"))
    written = spark.read.parquet(str(tmp_path / "matrix")).collect()
    assert all(len(r.ids) == len(r.positions) == 4 * 256 for r in written)
    assert sum(r.cu_seqlens[-1] for r in written) == sum(map(len, ids.values()))


def test_pack_refuses_a_vocabulary_without_the_end_token(spark, documents):
    with pytest.raises(Exception, match="no token"):
        pack(documents([(1, "a b")]), end_token="<|none|>").collect()


def plain_targets(sizes: dict) -> dict:
    """Targets by source: weights 5, 2, 1 in turn, 150 % of all words, at most twice a source's own."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_op4_meets_its_targets(spark, sf_small, texts):
    out = QUERIES["op4_mixing"](spark, sf_small)
    kinds = dict(out.dtypes)
    assert {c: kinds[c] for c in ("doc_id", "size", "source_size", "target", "taken")} == {
        "doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in texts.items()}
    sizes: dict = {}
    for i, r in texts.items():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[i]
    target, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        source = texts[r.doc_id]["source"]
        assert r.size == size[r.doc_id] and r.source_size == sizes[source] and abs(r.target - target[source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1


def test_op5_equals_the_library(spark, sf_small, texts, library):
    rows = QUERIES["op5_bpe"](spark, sf_small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id]["text"] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha(u4(ids))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False).encode())


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_op6_follows_the_rules(spark, sf_small):
    urls = {r["page_id"]: r["url"] for r in pq.read_table(f"{sf_small}/pages.parquet", columns=["page_id", "url"]).to_pylist()}
    rows = QUERIES["op6_url_filter"](spark, sf_small).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        host, path = plain_url(urls[r.page_id])
        fits = []
        for verdict, rule in URL_RULES:
            at, begin = rule.split("/", 1)
            if (host == at or host.endswith("." + at)) and path.startswith("/" + begin):
                fits.append((len(rule), rule, verdict))
        assert (r.host, r.path) == (host, path) and r.verdict in ("allow", "block")
        assert (r.rule, r.verdict) == max(fits)[1:] if fits else r.rule is None


def test_op7_counts_and_digests(spark, sf_small, texts):
    rows = QUERIES["op7_pii"](spark, sf_small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id]["text"] or "")
        kinds = [s.split(":")[0] for s in base.split(",") if s]
        assert r.base_sha256 == sha(base.encode())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_op8_scores_and_folds(spark, sf_small, texts):
    rows = QUERIES["op8_toxicity"](spark, sf_small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def plain_statistics(text: str):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count: dict = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_op9_base_statistics(spark, sf_small, texts):
    rows = QUERIES["op9_quality_rules"](spark, sf_small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = plain_statistics(texts[r.doc_id]["text"] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
