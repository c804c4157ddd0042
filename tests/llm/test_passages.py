"""Collocations, whitening and repeated passages against brute force, on odd rows and on empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemend.llm import phrases, substrings, whitening


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_phrases(rows, least, most, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, most + 1):
                for k in range(len(words) - m + 1):
                    f[lang, tuple(words[k : k + m])] += 1
    out = defaultdict(list)
    frequent = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, g), a in frequent.items():
        if any(
            x == lang and len(h) > len(g) and b >= a and any(h[j : j + len(g)] == g for j in range(len(h))) for (x, h), b in frequent.items()
        ):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(g).encode(), left, right))
    return sorted(
        (lang, r, g.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for r, (s, a, g, left, right) in enumerate(sorted(x)[:top], 1)
    )


def texts(seed, many, longest):
    random.seed(seed)
    words = ["a", "b", "C", "dé", "e", "é", "日本", "f\x1c", "g\x85h"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";\r\n", "?!", "\x0b"]
    return ["".join(random.choice(words) + random.choice(gaps) for _ in range(random.randint(0, longest))) for _ in range(many)]


@pytest.mark.parametrize(("every", "at_once"), [(64, 1 << 22), (3, 300)])
def test_collocations(spark, docs, monkeypatch, every, at_once):
    monkeypatch.setattr(phrases, "EVERY", every)
    monkeypatch.setattr(phrases, "AT_ONCE", at_once)
    rows = [(random.Random(i).choice(["en", "de", None, "und"]), t) for i, t in enumerate(texts(1, 80, 60))] + [("en", "a b c d e " * 300), ("en", None)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang string, text string, phrase string").repartition(3)
    found = sorted(tuple(r) for r in phrases.collocations(df, least=4, top=30).collect())
    assert found == brute_phrases(rows, 4, 5, 30) and len(found) > 60
    assert [len(r) for r in found] == [8] * len(found)
    assert phrases.collocations(df.filter("lang = 'none'")).count() == 0
    odd = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(docs, least=2).collect()) == brute_phrases(odd, 2, 5, 2000)


def test_collocations_of_great_counts(spark):
    """Products beyond 64 bits are exact."""
    a, n, left, right = 10**12 + 7, 9 * 10**14 + 1, 10**13 + 3, 10**12 + 9
    exact = "cast(cast({} as decimal(18, 0)) * cast({} as decimal(18, 0)) as decimal(37, 0))"
    row = spark.sql(f"select {exact.format('a * 1000', 'n')} div {exact.format('l', 'r')} s from (select {a}L a, {n}L n, {left}L l, {right}L r)")
    assert row.first().s == 1000 * a * n // (left * right)


def brute_repeats(rows, window):
    """A window is removed if an equal one starts under a smaller (doc_id, start)."""
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    least = {}
    for doc, text in rows:
        words = cut(text)
        for k in range(len(words) - window + 1):
            if doc is not None:
                g = tuple(words[k : k + window])
                least[g] = min(least.get(g, (doc, k)), (doc, k))
    out = []
    for doc, text in rows:
        words, gone = cut(text), set()
        for k in range(len(words) - window + 1):
            if doc is not None and least[tuple(words[k : k + window])] < (doc, k):
                gone |= set(range(k, k + window))
        out.append((doc, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "most"), [(20, 50_000), (20, 3), (4, 5), (7, 50_000), (1, 50_000)])
def test_repeated_passages(spark, docs, none, window, most):
    random.seed(window)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(60):
        words = [random.choice(base) for _ in range(random.randint(0, 30))]
        at = random.randrange(60)
        words += base[at : at + random.randint(0, 45)] + [random.choice(base) for _ in range(random.randint(0, 9))] + base[:25] * (i % 3)
        rows.append((random.choice([i, i // 3, None]) if i % 5 == 0 else i, " ".join(words)))
    rows += [(70, "a b " * 300), (71, "a b a " * 40), (72, "a b " * 20), (73, "x " * 200), (70, "a b " * 300), (74, None), (75, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, start int").repartition(4)
    found = substrings.drop_repeats(df, window, most)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()), key=str)
    assert got == brute_repeats(rows, window)
    assert found.filter(F.expr("n_removed <> aggregate(spans, 0L, (s, x) -> s + x.last - x.first + 1)")).count() == 0
    odd = substrings.drop_repeats(docs, window, most).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in odd), key=str) == brute_repeats([(r.doc_id, r.text) for r in docs.collect()], window)
    assert substrings.drop_repeats(none).count() == 0


def test_repeated_passages_of_long_texts(spark):
    """A text of several slices, and two records of it under one prefix end."""
    random.seed(8)
    long = " ".join(f"{random.choice('abcdefgh')}{k % 5000 // 7}" for k in range(150_000))
    rows = [(1, long[: 200_000]), (2, long), (3, "z " + long[300_000:300_200])]
    found = substrings.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == brute_repeats(rows, 20)


def brute_white(rows, factor=256):
    held = [(i, np.array([int(np.floor(float(c) * factor)) for c in v], object)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(x) for _, x in held)
    held = [(i, np.concatenate([x, np.zeros(width - len(x), object)])) for i, x in held]
    fit = np.array(sorted({tuple(x) for _, x in held}), object)
    n, s = len(fit), fit.sum(0)
    a = ((n * fit - s) / n).astype(np.float64)
    values, vectors = np.linalg.eigh(a.T @ a / n)
    return held, n, s, values[::-1], vectors[:, ::-1]


def check_white(spark, rows, components):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, n int").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found = whitening.whiten(df).collect()
    held, n, s, values, vectors = brute_white(rows)
    assert len(found) == len(held) * components
    by = defaultdict(list)
    for r in found:
        by[r.vec_id, r.component].append(r)
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9 and r.n == n
    for c in range(1, components + 1):
        wanted = [float(((x - s / n).astype(float) @ vectors[:, c - 1]) / np.sqrt(values[c - 1])) for _, x in held]
        got = [by[i, c] for i, _ in held]
        pairs = [(w, g.whitened, g.deviation, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))) for w, gs, (_, x) in zip(wanted, got, held, strict=True) for g in gs if len(gs) == 1]
        sign = np.sign(sum(w * g for w, g, _, _ in pairs))
        assert all(abs(w - sign * g) < 1e-7 and d == e for w, g, d, e in pairs) and pairs


def test_whitening(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, [5, 4, 2, 1, 0.5, 0.1], 6)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6)]
    rows += [(5, rows[9][1]), (None, rows[7][1]), (2004, []), (2005, [1.0, -0.0]), (2006, [1e4, 1.0, 0.0, 0.0, 0.0, -1e4])]
    check_white(spark, rows, 4)
    assert whitening.whiten(spark.createDataFrame(rows[:1], "vec_id bigint, embedding array<float>")).count() == 0
    assert whitening.whiten(spark.createDataFrame(rows[:1], "vec_id bigint, embedding array<float>").filter("vec_id < 0")).count() == 0


def test_whitening_without_variance(spark):
    """Fewer directions than components, and columns that depend on each other."""
    rng = np.random.default_rng(5)
    base = rng.integers(-9, 9, (200, 2)) / 4
    check_white(spark, [(i, [float(a), float(a + b), float(b), 1.0, float(a - b)]) for i, (a, b) in enumerate(base)], 2)
    check_white(spark, [(i, [float(a)]) for i, a in enumerate(base[:, 0])], 1)


def test_factor_of_bad_condition():
    """Condition 1e10: a Gram matrix alone has no factor; the passes give the singular values to double precision."""
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.normal(size=(500, 12)))
    v, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    sizes = np.logspace(0, -10, 12)
    a = (q * sizes) @ v.T
    found = np.linalg.svd(whitening.factor_of(lambda solve: (a @ solve).T @ (a @ solve), 500, 12))[1]
    assert np.abs(found / np.linalg.svd(a)[1] - 1).max() < 1e-4
    assert np.abs(found[:4] / sizes[:4] - 1).max() < 1e-12


def test_kept_digest(spark, docs):
    row = substrings.drop_repeats(docs).selectExpr("doc_id", "sha2(cast(kept as binary), 256) h").filter("doc_id = 4").first()
    assert row.h == hashlib.sha256(b"").hexdigest()
