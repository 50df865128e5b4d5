"""Runs, exact top-k search and the Merkle manifest against plain forms of themselves, and on nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from chronoplate.llm import merkle, queries, runs, topk

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, key STRING, place INT, tree STRING, row INT, words STRING, h INT"


def frame(spark, rows):
    """Rows of (doc_id, text, lang)."""
    return spark.createDataFrame([(i, t, lang, f"s{(i or 0) % 3}", None if t is None else len(t), "x", 1, "y", 2, "z", 3) for i, t, lang in rows], SCHEMA)


def plain_runs(t, least, times):
    found = {}
    for q in range(1, len(t) // times + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, q, e - s) for (s, e), q in found.items())


def repetitive(rng, most):
    t, n = [], rng.randint(0, most)
    while len(t) < n:
        kind = rng.random()
        if kind < 0.3 and t:
            a = rng.randrange(len(t))
            t += t[a : a + rng.randint(1, 40)]
        elif kind < 0.6:
            block = [rng.randint(0, 2) for _ in range(rng.randint(1, 6))]
            t += (block * 20)[: rng.randint(1, 20 * len(block))]
        else:
            t.append(rng.randint(0, 3))
    return t


def test_runs_equal_a_search_of_all_periods():
    rng = random.Random(1)
    for _ in range(3000):
        least, times = rng.choice([(24, 3), (4, 2), (6, 3), (10, 2), (1, 2), (12, 4)])
        t = repetitive(rng, 90)
        want = plain_runs(t, least, times)
        assert runs.runs_of(t, least, times) == want
        assert runs.find([b"%d" % x for x in t], least, times) == [(s, length, q) for s, q, length in want]


def test_factors_are_the_longest_earlier_stretches():
    rng = random.Random(2)
    for _ in range(300):
        t = repetitive(rng, 40)
        for p, length, source in runs.factors(t):
            longest = max((n for n in range(len(t) - p + 1) if any(t[j : j + n] == t[p : p + n] for j in range(p))), default=0) if p else 0
            assert length == max(longest, 1)
            assert source == (-1 if not longest else min(j for j in range(p) if t[j : j + longest] == t[p : p + longest]))


def test_runs_query_equals_a_plain_form(spark, tmp_path):
    rng = random.Random(3)
    rows = [(None, "a " * 40, "en"), (1, None, "en"), (2, "", None), (3, " \n\t", "en"), (4, "ja ja " * 30, "en"), (5, "a b " * 5_000 + "c", "en"), (5, "a b " * 5_000 + "c", "en")]
    rows += [(i, " ".join(f"w{x}" for x in repetitive(rng, 200)), "de") for i in range(10, 150)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, text, _ in rows:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = plain_runs(words, 24, 3) if n < 1000 else [(0, 2, 10_000)]
        best = max(found, key=lambda r: (r[2] / r[1], -r[0], -r[1]), default=None)
        gone = {k for s, q, length in found for k in range(s + q, s + length)}
        lines = "".join(f"{s},{length},{q}\n" for s, q, length in found)
        told = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        want.append((i, n, len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()))
    assert got == sorted(want, key=str)
    assert any(r[2] > 1 for r in want)


def test_collapse_takes_empty_tables_and_refuses_one_period(spark):
    assert runs.collapse(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        runs.collapse(frame(spark, []), times=1)


def plain_top(vectors, asks, k):
    ok = [(r, i, v) for r, (i, v) in enumerate(vectors) if v is not None and all(x is not None and abs(x) != float("inf") and x == x for x in v)]
    out = []
    for r, i, v in ok:
        if asks(i):
            scored = [(-min(sum(int(a) * int(b) for a, b in zip(v, w, strict=False)), 2**63 - 1), j is None, j or 0, j) for s, j, w in ok if s != r]
            out += [(i, n + 1, j, -s) for n, (s, _, _, j) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("spread", [1, 3, 40])
def test_top_k_equals_all_products(spark, spread):
    rng = random.Random(spread)
    vectors = [(i, [float(rng.randint(-spread, spread)) if rng.random() < 0.7 else 0.0 for _ in range(12)]) for i in range(300)]
    vectors += [(i, vectors[7][1]) for i in range(300, 420)]  # many copies of one vector
    vectors += [(7, vectors[7][1]), (None, [3.0] * 12), (20, [1.0] * 5), (60, []), (21, None), (40, [1.0, None]), (80, [float("nan")] * 12), (100, [float("inf")] * 12)]
    df = spark.createDataFrame(vectors, "vec_id BIGINT, embedding ARRAY<DOUBLE>").withColumns({"row": F.lit(1), "id": F.lit("x"), "shard": F.lit(0)})
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 6, shard_rows=50, block_rows=7)
    assert sorted(map(tuple, got.collect()), key=str) == plain_top(vectors, lambda i: i is not None and i % 20 == 0, 6)


def test_top_k_of_huge_few_and_no_vectors(spark):
    huge = [(0, [2.0**40, 3.0]), (20, [2.0**40, -5.0]), (1, [2.0**40 + 1, 2.0]), (2, [2.0**10, 7.0])]
    df = spark.createDataFrame(huge, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 2).collect()), key=str) == plain_top(huge, lambda i: i % 20 == 0, 2)
    assert topk.top_k(df.limit(0), F.lit(True), 2).count() == 0
    assert topk.top_k(df, F.lit(False), 2).count() == 0
    assert topk.top_k(df.limit(1), F.lit(True), 2).count() == 0


def test_search_prunes_and_keeps_all_that_reach_the_floor():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(200):
        x = rng.integers(-9, 10, (60, 10)).astype(float)
        q = np.round(rng.normal(0, 4, 10) ** 3)
        scores = x @ q
        floor = int(np.sort(scores)[-rng.integers(1, 20)])
        rows, sums = topk.Shard(x).search(q, floor)
        assert set(np.flatnonzero(scores >= floor)) <= set(rows) and (sums == scores[rows]).all()
        if floor > 0:
            assert (sums >= floor).all()


def plain_manifest(rows):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(digests):
        """(root, proofs as lists of (before, after))"""
        level, at, proofs = digests, list(range(len(digests))), [[] for _ in digests]
        while len(level) > 1:
            for n, i in enumerate(at):
                run = level[i // 8 * 8 : i // 8 * 8 + 8]
                proofs[n].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
                at[n] = i // 8
            level = [h("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        return level[0], proofs

    by = {}
    for doc, text, lang in rows:
        n = None if text is None else len(text)
        base = "".join(map(field, (doc, f"s{(doc or 0) % 3}", lang, n)))
        low = text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        bad = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        by.setdefault(lang, []).append(((doc is not None, doc or 0, h(base + field(text))), h(base + field(low)) if bad else None, doc))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: tree([x[0][2] for x in sorted(by[lang], key=lambda x: x[0])]) for lang in langs}
    root, tops = tree([trees[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for (key, low, doc), path in zip(sorted(by[lang], key=lambda x: x[0]), trees[lang][1], strict=True):
            fold = low or key[2]
            for a, b in [*path, *top]:
                fold = h(a + fold + b)
            out.append((doc, key[2], trees[lang][0], root, h("".join(a + b for a, b in [*path, *top])), fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 64, "de": 65, None: 7, "": 1, "é": 2, "z": 130}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_manifest_equals_a_plain_tree(spark, tmp_path, sizes):
    rng = random.Random(5)
    rows = [(rng.choice([rng.randint(0, 10**6), rng.randint(0, 20), None]), rng.choice([None, "", "Some Text é", "none upper"]), lang) for lang, n in sizes.items() for _ in range(n)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == plain_manifest(rows)


def test_manifest_of_no_rows(spark):
    docs = frame(spark, [])
    assert merkle.manifest(docs, merkle.leaf(F.col("doc_id")), F.col("lang"), [F.col("doc_id")], [F.col("doc_id")]).count() == 0
