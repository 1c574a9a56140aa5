"""Each operator against a brute-force version on a small table with nulls, empty and repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

SYLLABLES = ["th", "an", "er", "ou", "ing", "le", "é", "ß", "tion", "ca", "st"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    return [base, " ".join(near), base, prose(rng, 90), "", None, "  ", "a b", "one two three four five", "Ünïcode ﬁ ΣΑΣ\x1c x　y\r\n\r\nz  <|endoftext|> 日本語", prose(rng, 2500), "mail a@b.co\ncard 4111 1111 1111 1111", prose(rng, 40) + "\n" + base]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 7}", None, "clash", 7) for i, t in enumerate(texts())] + [(None, "no id at all here", None, None, None, None, None), (3, texts()[3], "en", "s3", None, "clash", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed string, node long")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_token_counts_equal_the_library(spark, docs):
    import sentencepiece

    from tracewell.llm.prefix_tokens import count_tokens, counter, truncation_points

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = count_tokens(docs, path, keep=("doc_id", "text")).collect()
    assert len(got) == docs.count() and all(r.n_tokens == len(sp.encode(r.text or "")) for r in got)
    c, t = counter(path), texts()[9]
    assert c.prefix_counts(t) == [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
    for r in truncation_points(docs, path, 30, keep=("text",)).collect():
        n = [len(sp.encode(r.text[:i])) for i in range(min(len(r.text), 200) + 1)] if r.text else [0]
        assert r.cut == next((i for i, x in enumerate(n) if x > 30), len(n)) - 1
    assert count_tokens(docs.limit(0), path, keep=("doc_id",)).count() == 0


def test_word_codec_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    from tracewell.llm.bpe_automaton import decode_ids, encode_decode

    path = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    out = encode_decode(docs, path, keep=("doc_id", "text"))
    for r in out.collect():
        ids = tk.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == " ".join(map(str, ids)) and r.n_tokens == len(ids) and r.decoded == tk.decode(ids, skip_special_tokens=False)
    again = decode_ids(out.withColumnRenamed("decoded", "was"), path, keep=("was",))
    assert all(r.was == r.decoded for r in again.collect())


def test_automaton_agrees_with_plain_merging():
    from tracewell.llm.bpe_automaton import TokenAutomaton

    rng = random.Random(1)
    for _ in range(40):
        labels, merges, pairs = list("abc"), [], set()
        while len(merges) < 12:
            u, v = rng.randrange(len(labels)), rng.randrange(len(labels))
            if labels[u] + labels[v] not in labels and len(labels[u] + labels[v]) <= 8:
                merges.append((u, v, len(labels)))
                labels.append(labels[u] + labels[v])
                pairs.add((u, v))
        a = TokenAutomaton(labels, [0, 1, 2], merges)
        inner = dict.fromkeys((t[:i] for t in labels for i in range(1, len(t))), -1) | {t: i for i, t in enumerate(labels)}
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            ids = ["abc".index(x) for x in word]
            for u, v, w in merges:
                out, i = [], 0
                while i < len(ids):
                    if ids[i : i + 2] == [u, v]:
                        out.append(w)
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            assert a.spell(word, inner, {t: i for i, t in enumerate(labels)}, 20) == ids, (word, labels)


def test_packing_holds_every_id_once(spark, docs):
    from tokenizers import Tokenizer

    from tracewell.llm.packing import pack, shortest_pack_first

    path = P.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    rows = pack(docs, path, keep=("doc_id",), capacity=64).collect()
    want = Counter()
    for r in docs.collect():
        want[(r.doc_id, tuple(tk.encode(r.text or "", add_special_tokens=False).ids + [0]))] += 1
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    assert sorted(by) == list(range(len(by)))
    for part in by.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at <= 64
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for (doc, ids), n in want.items():
        if sum(k[0] == doc for k in want) == 1:
            got = sorted(pieces[doc], key=lambda r: r.start)
            assert b"".join(r.ids for r in got[::n]) == np.array(ids, "<u4").tobytes()
    rng = random.Random(2)
    h = Counter(min(63, 1 + int(rng.expovariate(0.06))) for _ in range(3000))
    patterns = shortest_pack_first(dict(h), 64)
    placed = Counter()
    for n, p in patterns:
        assert sum(p) <= 64
        for x in p:
            placed[x] += n
    assert placed == h and sum(k * v for k, v in h.items()) / (64 * sum(n for n, _ in patterns)) > 0.97
    assert pack(docs.limit(0), path, capacity=64).count() == 0


def test_classifier(spark, sf):
    from tracewell.llm.quality_fm import FactorisationMachine, features, fit, held_out, score

    d, lab = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    m = fit(d, lab)
    rows = score(d, m).join(lab, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(rows) > 50 and sum(r.quality_pred == r.quality for r in rows) / len(rows) > 0.95
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5) == 0 for r in rows)
    at, x = features("Some words. Some MORE words!\nline")
    v = m.v[at] * x[:, None]
    pairs = sum(float(v[i] @ v[j]) for i in range(len(at)) for j in range(i))
    assert math.isclose(m.raw(at, x), m.w0 + m.w[at] @ x + pairs, rel_tol=1e-9, abs_tol=1e-9)
    odd = score(frame(spark, [(1, None), (2, ""), (None, "x")]), m).collect()
    assert len(odd) == 3 and odd[0].quality_score == odd[1].quality_score and all(0 <= r.quality_score <= 1 for r in odd)
    assert score(frame(spark, [(1, "x")]), fit(d, lab.limit(0))).first().quality_score == 0.5
    assert FactorisationMachine().score(None) == 0.5


def jaccard(a, b):
    a, b = ([" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))] if (w := re.findall(r"[^\W_]+", (t or "").lower())) else [] for t in (a, b))
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / max(sum((a | b).values()), 1) if a and b else 0.0


def grouped(items, linked):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_signature_is_unbiased():
    from tracewell.llm.bagminhash import mix, numbered, signature

    rng, errors = random.Random(3), []
    for _ in range(120):
        base = [rng.randrange(10**6) for _ in range(rng.choice([3, 20, 150]))]
        cut = rng.randrange(len(base))
        a, b = (np.array(x + [1] * rng.randrange(1, 40), np.uint64) for x in (base, base[cut:] + [rng.randrange(10**6) for _ in range(cut // 2)]))
        x, y = set(numbered(mix(a)).tolist()), set(numbered(mix(b)).tolist())
        errors.append((signature(mix(a)) == signature(mix(b))).mean() - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.06


def test_near_duplicates(spark, docs):
    from tracewell.llm.bagminhash import keep_one, near_duplicates

    rows = [r for r in docs.select("doc_id", "text").collect()]
    got = near_duplicates(docs).collect()
    root = grouped([r.text for r in rows], lambda a, b: jaccard(a, b) >= 0.8)
    want = Counter((r.doc_id, rows[k].doc_id) for r, k in zip(rows, root))
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {rows[k].doc_id for k in root}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_a_group_with_borderline_members(spark):
    from tracewell.llm.bagminhash import near_duplicates

    rng = random.Random(9)
    base = prose(rng, 150).split()
    group = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        group.append(" ".join(w))
    got = {r.doc_id: r.class_id for r in near_duplicates(frame(spark, list(enumerate(group)))).collect()}
    assert [got[i] for i in range(60)] == grouped(group, lambda a, b: jaccard(a, b) >= 0.8)


def test_bm25(spark, docs):
    from tracewell.llm.bm25_wand import top_k

    rows = [(r.doc_id, Counter(re.findall(r"[^\W_]+", (r.text or "").lower()))) for r in docs.collect()]
    n, mean = len(rows), sum(sum(c.values()) for _, c in rows) / len(rows)
    df = Counter(t for _, c in rows for t in c)
    got = defaultdict(list)
    for r in top_k(docs, F.col("doc_id") % 2 == 0, k=4, shard=5, queries=3).orderBy("rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for q, terms in rows:
        if q is not None and q % 2 == 0 and terms:
            hits = []
            for d, c in rows:
                dl = sum(c.values())
                s = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl / mean)) for t, m in terms.items() if t in c)
                if s > 0 and d is not None:
                    hits.append((-round(s, 6), d))
            want = [(d, -s) for s, d in sorted(hits)[:4]]
            assert [d for d, _ in got[q]] == [d for d, _ in want] and np.allclose([s for _, s in got[q]], [s for _, s in want], atol=2e-6)
    assert top_k(docs.limit(0), F.col("doc_id") % 2 == 0).count() == 0


def test_line_dedup(spark):
    from tracewell.llm.line_spread import remove_boilerplate

    body = "one fairly long line of text {0}\nanother line of text {0}\n\n  shared line \nlast {0}"
    rows = [(i, body.format(f"{i}" * 9), f"s{i}", "x") for i in range(6)] + [(10 + i, "only on four sites\nits own words " + "ab" * 9 + str(i), f"s{i}", "x") for i in range(4)] + [(20, None, "s1", None), (21, "", "s1", None), (22, "shared line", None, None), (23, "shared line", "s1", "x"), (0, body.format("0" * 9), "s0", "x")]
    df = frame(spark, rows, "doc_id long, text string, source string, gone string")
    got = remove_boilerplate(df, min_sites=5).collect()
    assert len(got) == len(rows) and got[0].gone in ("x", None)
    for r in got:
        if r.doc_id < 6:
            assert r.text == body.format(f"{r.doc_id}" * 9).replace("  shared line \n", "") and r.n_removed == 1
        else:
            assert r.text == dict((x[0], x[1]) for x in rows)[r.doc_id] and r.n_removed == 0
    assert remove_boilerplate(df.limit(0)).count() == 0


def test_repeated_passages(spark, docs):
    from tracewell.llm.sparse_suffix import repeated_passages, spans_of

    rows = docs.select("doc_id", "text").collect()
    words = [[m for m in re.finditer(r"[^\W_]+", r.text or "")] for r in rows]
    low = [[m.group().lower() for m in w] for w in words]
    n, seen = 50, Counter()
    for w in low:
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    want = Counter()
    for r, m, w in zip(rows, words, low):
        at = np.array([i for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1], int)
        for a, b in zip(*spans_of(at, at, n)):
            want[(r.doc_id, m[a].start(), m[b - 1].end(), b - a)] += 1
    got = Counter(tuple(r) for r in repeated_passages(docs).collect())
    assert got == want and len(want) >= 5
    assert repeated_passages(docs.limit(0)).count() == 0


def test_embeddings(spark):
    from tracewell.llm.embed_int8 import near_duplicates, quantise

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    vecs = [(centres[i % 6] + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.4])).astype(np.float32) for i in range(150)]
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vecs)] + [(200, rows0 := [float(x) for x in vecs[0]], 0), (201, rows0, None), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, [None] * 16, 0), (206, [1.0] * 8, 0), (207, [2.0] * 8, 0), (208, [], 0), (None, rows0, 0)]
    df = frame(spark, rows, "vec_id long, embedding array<float>, label int")

    def ok(v, label):
        return v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        if not (ok(*a[1:]) and ok(*b[1:])) or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
        return x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93

    root = grouped(rows, linked)
    members = defaultdict(list)
    for r, k in zip(rows, root):
        members[k].append(r[0])
    want = Counter((r[0], sum(linked(r, s) for j, s in enumerate(rows) if j != i), min((m for m in members[root[i]] if m is not None), default=None)) for i, r in enumerate(rows))
    got = near_duplicates(df, block=20).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    unit = rng.normal(size=(50, 64))
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    q, s, e, length = quantise(unit)
    off = np.abs(unit @ unit.T - (q * s[:, None]) @ (q * s[:, None]).T)
    assert (off <= e[:, None] + length[:, None] * e[None, :] + 1e-12).all()
    assert near_duplicates(df.limit(0)).count() == 0


def base_spans(t):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(x) > 255 for x in m.group().split("."))) or (kind == "card" and not (13 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, docs):
    from tracewell.llm.pii_boost import BASE, find, fit, redact

    model = fit(spark)
    rng = random.Random(6)
    fuzz = ["".join(rng.choice('a.b@c-1234567890 +()_%é😀 00.1.2.3 (at) token="') for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    fuzz += ["a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8.9", "+1 (017) 555-7713 or 4111-1111-1111-1111", "000001.2.3.4", "256.1.1.1", None, "", "1" * 20000, "a" * 20000 + "@"]
    df = frame(spark, list(enumerate(fuzz)), "doc_id long, text string")
    for r in find(df, model=model).collect():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in BASE] == base_spans(r.text)
    keys = frame(spark, [(1, f'x token = "{hashlib.sha1(b"1").hexdigest()}" y'), (2, "see some-very-long-page-title-in-lower-case here"), (3, "please call 555-123-4567 now"), (4, "mail joe (at) example (dot) org")])
    found = {r.doc_id: [s.kind for s in r.spans] for r in find(keys, model=model).collect()}
    assert found == {1: ["secret"], 2: [], 3: ["phone_local"], 4: ["email_written"]}
    clean = {r.doc_id: r.text for r in redact(find(keys, model=model)).collect()}
    assert clean[1] == 'x token = "[SECRET]" y' and clean[2].startswith("see some") and clean[3] == "please call [PHONE_LOCAL] now"
    assert find(docs.limit(0), model=model).count() == 0


def test_pipeline(spark, tmp_path, sf):
    import corpus_pipeline
    from tracewell.llm.common import materialise

    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts_ = {r.doc_id: r.text for r in df.collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "PII", "packing"]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialise(stage(spark, df.withColumn("extra", F.lit(1)) if k < 4 else df, sf), "t")
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id for r in out.select("doc_id").distinct().collect()})
        df = out
    assert seen[0] == seen[1] and seen[2] == seen[3] == seen[4]
    assert sum(quality[d] == 1 and d in seen[0] for d in quality) / sum(q == 1 for q in quality.values()) > 0.95
    left = sorted(seen[2])
    assert not any(texts_[a] == texts_[b] for i, a in enumerate(left) for b in left[:i] if texts_[a])
    assert (tmp_path / "x").exists() is False
