"""The registered queries as the driver calls them: their digest columns against the libraries and plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracewell.llm import packing, pii_boost, registry

ODD = [None, "", " ", "plain words only", "same text", "same text", "x" * 5000, "naïve 日本語 \U0001f600 é", "mail a.b@c-d.org, card 4111 1111 1111 1111, ip 10.0.0.256 10.0.0.1", "tab\tand\r\nline " * 50, "<|endoftext|> <s> </s> <unk>"]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """documents with odd texts, a clash of columns and more than one row an id, beside the given labels and embeddings."""
    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(10_000 + i, t, "en", None if i % 3 else f"s{i}", len(t or "")) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long").select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns))
    docs.unionByName(odd).withColumn("rank", F.lit(1)).withColumn("n_removed", F.lit(2)).write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "embeddings"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    return at


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def test_packing(spark, folder, texts, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for i, x in texts.items()}
    for part in (1 << 20, 0.02):  # one part, then several in each bucket
        monkeypatch.setattr(packing, "PART", part)
        rows = registry.queries()["op2_packing"](spark, folder).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
            ids = want[r.doc_id]
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert pieces.keys() == want.keys()
        for i, ps in pieces.items():
            at = 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at
                at += p.length
            assert at == len(want[i])
        for ps in sequences.values():
            at = 0
            for p in sorted(ps, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 1024
        used = sum(len(x) for x in want.values())
        assert len(sequences) <= -(-used // 1024) + 2


def test_token_counts(spark, folder, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = registry.queries()["op7_token_counts"](spark, folder).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {(i, len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for i, t in texts.items()}


def test_word_codec(spark, folder, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    for r in registry.queries()["op10_bpe_codec"](spark, folder).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))), texts[r.doc_id][:80]


def luhn(digits):
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
}


def test_personal_data(spark, folder, texts):
    for r in registry.queries()["op9_pii"](spark, folder).collect():
        found = [(k, m.start(), m.end()) for k, (p, good) in BASE.items() for m in re.finditer(p, texts[r.doc_id]) if good(m.group())]
        n = Counter(k for k, _, _ in found)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in BASE)
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))
        base = [s for s in r.spans.split(",") if s.split(":")[0] in BASE]
        assert base == [f"{k}:{a}:{b}" for k, a, b in found]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@h{i}.org" for i in range(20_000))
    df = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, spans int")
    import time

    start = time.time()
    found = pii_boost.find(df, model=pii_boost.fit(spark)).select(F.size(F.filter("spans", lambda s: s["kind"] == "email")).alias("n"), F.element_at("spans", 20_000).alias("last")).first()
    assert found.n == 20_000 and text[found.last.start : found.last.end] == "u19999@h19999.org" and time.time() - start < 90


def test_held_out_formats(spark):
    got = pii_boost.held_out(spark)
    assert all(p >= 0.9 and r >= 0.9 for p, r in got.values()), got


def test_calibration():
    a, b = pii_boost.platt([(2.0, 1, 50.0), (-2.0, 0, 50.0), (0.0, 1, 5.0), (0.0, 0, 5.0)])
    p = lambda s: 1 / (1 + np.exp(-(a * s + b)))
    assert abs(p(0) - 0.5) < 0.02 and p(2) > 0.95 and p(-2) < 0.05
    assert pii_boost.platt([])[0] > 0


def test_quality(spark, folder, texts):
    rows = registry.queries()["op1_quality_fm"](spark, folder).collect()
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    same = {texts[r.doc_id]: set() for r in rows}
    for r in rows:
        same[texts[r.doc_id]].add(r.score)
    assert all(len(s) == 1 for s in same.values())


def test_embeddings_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    v = {r.vec_id: (np.array(r.embedding, float), r.label) for r in rows if r.embedding is not None and r.label is not None}
    link, parent = defaultdict(set), {r.vec_id: r.vec_id for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(v)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            (x, k), (y, m) = v[a], v[b]
            size = np.sqrt(x @ x) * np.sqrt(y @ y)
            if k == m and np.isfinite(size) and size > 0 and x @ y / size >= 0.93:
                link[a].add(b)
                link[b].add(a)
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in registry.queries()["op8_embedding_dedup"](spark, folder).collect()}
    assert got == {i: (len(link[i]), root(i), root(i) == i) for i in parent}


def test_pipeline_of_odd_rows(spark, folder, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    kept = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert kept.where("text = 'same text'").count() == 1 and kept.where("text is null").count() == 1
    empty = str(tmp_path)
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
