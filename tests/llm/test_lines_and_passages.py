"""Line dedup, repeated passages, long tokens and secrets, against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F


def test_line_dedup_whatever_share_is_left(spark, sf):
    from tracewell.llm import line_spread as ls

    rows = [(i, f"a licence line that is long\nown {i}", f"s{i}") for i in range(5)] + [(10 + i, "copied one\n\ncopied two", f"s{i}") for i in range(5)] + [(20, "own\nown too\na licence line that is long", None), (21, "a licence line that is long\ncopied one", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_removed) for r in ls.remove_boilerplate(df).collect()}
    assert all(got[i] == (f"own {i}", 1) for i in range(5)) and got[20] == ("own\nown too", 1)
    assert all(got[i] == (t, 0) for i, t, _ in rows[5:10] + rows[11:])
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    cut = {r.doc_id: [x.strip(" ") for x in r.text.split("\n")] if r.text is not None else [] for r in docs}
    sites = defaultdict(set)
    for r in docs:
        for line in cut[r.doc_id]:
            sites[line] |= {r.source} - {None}
    bad = {line for line, s in sites.items() if line and len(s) >= 5}
    for r in ls.op5_line_spread(spark, sf).collect():
        n = sum(line in bad for line in cut[r.doc_id])
        assert r.n_removed == (n if any(line and line not in bad for line in cut[r.doc_id]) else 0)


def test_quality_features_read_long_tokens_whole():
    from tracewell.llm.quality_fm import BINS, STATISTICS, features

    token = "a" * 64 + "B" * 100 + "7" * 50 + "+" * 36 + "a" * 50
    at, x = features(token)
    upper, digit, other = x[list(at).index(BINS - STATISTICS + 4) :][:3]
    assert (upper, digit, other) == (100 / 300, 50 / 300, 36 / 300)
    shape = lambda t: features(t)[0][1]
    assert shape("a" * 70) == shape("b" * 90) and shape("a" * 70) != shape("a" * 70 + "7")


def test_secrets_need_no_digit(spark):
    from tracewell.llm.pii_boost import find, fit, matches

    key = "".join(random.Random(4).choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(40))
    rows = [(1, f'x token = "{key}" y'), (2, f'x token = "{key}" y 7'), (3, "no run of that length " * 9), (4, "a" * 19), (5, "a" * 20), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(m.start, m.end, m.value) for m in r.m or []] for r in df.select("doc_id", matches(F.col("text"), "secret").alias("m")).collect()}
    assert found == {1: [(11, 51, key)], 2: [(11, 51, key)], 3: [], 4: [], 5: [(0, 20, "a" * 20)], 6: []}
    kinds = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in find(df, model=fit(spark)).collect()}
    assert kinds[1] == kinds[2] and kinds[3] == kinds[6] == []


def test_line_dedup_of_long_texts_and_clashing_columns(spark):
    import time

    from tracewell.llm import line_spread as ls

    n = 60_000
    long = "\n".join(f"own {i}" if i % 2 else f"shared {i % 50}" for i in range(n))
    rows = [(0, "s0", long, 7)] + [(k, f"s{k}", "\n".join(f"shared {i}" for i in range(0, 50, 2)) + f"\n own {k}", 8) for k in range(1, 6)] + [(9, None, None, 9), (10, "s1", "", 9), (11, "s1", "\n \n", 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_removed int")
    start = time.time()
    got = {r.doc_id: r for r in ls.remove_boilerplate(df).collect()}
    assert time.time() - start < 60
    assert got[0].n_removed == n // 2 and got[0].text == "\n".join(f"own {i}" for i in range(1, n, 2))
    assert got[1].text == " own 1" and got[9].text is None and got[10].text == "" and got[11].text == "\n \n" and got[11].n_removed == 0
    assert sorted(ls.remove_boilerplate(df).columns) == ["doc_id", "n_removed", "source", "text"]
    assert ls.remove_boilerplate(df.limit(0)).count() == 0


def brute_spans(rows, n=50):
    """Every maximal union of runs of n words that occur elsewhere (in another text, elsewhere in it, or in a copy)."""
    found = [(i, [m for m in re.finditer(r"[^\W_]+", t or "")]) for i, t in rows]
    low = [[m.group().lower() for m in w] for _, w in found]
    seen = Counter(tuple(w[i : i + n]) for w in low for i in range(len(w) - n + 1))
    out = Counter()
    for (ident, m), w in zip(found, low):
        spans = []
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + n
                else:
                    spans.append([i, i + n])
        out.update((ident, m[a].start(), m[b - 1].end(), b - a) for a, b in spans)
    return out


@pytest.mark.parametrize("seed, group", [(1, 1024), (2, 1024), (3, 2), (4, 5)])
def test_passages_cut_anywhere(spark, seed, group):
    """Texts made of cuts of a few passages, so that matches end at any place on either side; large groups and small."""
    from tracewell.llm.sparse_suffix import repeated_passages

    rng = random.Random(seed)
    word = lambda: rng.choice(["ant", "bee", "cat", "dog", "elk", "fox", "gnu", "hen", "\u0130ris", "\u00dcber"]) + str(rng.randrange(400))
    passages = [[word() for _ in range(140)] for _ in range(4)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += [word() for _ in range(rng.randrange(0, 30))]
            p = rng.choice(passages)
            a = rng.randrange(0, 100)
            text += p[a : a + rng.randrange(20, 110)]
        rows.append((i, " ".join(text)))
    rows += [(100, rows[0][1]), (101, rows[0][1].upper()), (None, rows[1][1]), (102, None), (103, ""), (104, "few words only")]
    rows += [(105, " ".join(["same"] * 300)), (106, " ".join(passages[0] + passages[1] * 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in repeated_passages(df, group=group).collect())
    assert got == brute_spans(rows)


def test_a_passage_most_texts_share(spark):
    from tracewell.llm.sparse_suffix import repeated_passages

    rng = random.Random(9)
    shared = " ".join(f"w{rng.randrange(9999)}" for _ in range(70))
    rows = [(i, f"{' '.join(f'a{rng.randrange(99999)}' for _ in range(40))} {shared} {' '.join(f'b{rng.randrange(99999)}' for _ in range(40))}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    for group in (64, 1024):
        got = repeated_passages(df, group=group).collect()
        assert Counter(map(tuple, got)) == brute_spans(rows) and {r.n_words for r in got} == {70}


def test_passages_of_a_very_long_text(spark):
    from tracewell.llm.sparse_suffix import repeated_passages

    rng = random.Random(5)
    words = [f"x{rng.randrange(30)}y{rng.randrange(2000)}" for _ in range(40_000)]
    words[30_000:30_080] = words[100:180]
    rows = [(1, " ".join(words)), (2, " ".join(words[500:700])), (3, " ".join(["tick"] * 5000))]
    assert Counter(map(tuple, repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_spans(rows)
