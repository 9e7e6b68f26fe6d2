"""Whitening, fingerprints and hard negatives against plain versions."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from wiregraph.llm import fingerprints, negatives, whitening

VECTORS = "vec_id long, embedding array<float>, label int, v string, id string, part string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, k, "v", "i", "p") for i, e, k in rows], VECTORS).repartition(5)


@pytest.fixture(scope="module")
def some():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(420, 12)) * np.linspace(3, 0.3, 12)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:240] = x[100] + rng.normal(size=(140, 12)) * 0.004
    x[240:300] = x[240]
    rows = [(int(i), [float(np.float32(c)) for c in v], int(rng.integers(0, 4))) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.1] * 11 + [None], 1), (1002, [0.1] * 11 + [float("nan")], 1), (1003, [float("inf")] + [0.1] * 11, 1), (None, rows[5][1], 2), (1100, rows[7][1], None), rows[50], rows[50]]
    return rows + odd


@pytest.mark.parametrize("d,n,rank", [(1, 9, 1), (6, 40, 6), (16, 10, 9), (16, 200, 3), (9, 60, 0)])
def test_spectra(d, n, rank):
    """Rank-one updates and merges give the eigendecomposition of the scatter, for full and lacking rank and ties."""
    rng = np.random.default_rng(d + n)
    x = (rng.integers(-300, 300, (n, min(rank, d))) @ rng.integers(-3, 4, (min(rank, d), d)) if rank < d else rng.integers(-300, 300, (n, d))) + 100_000
    x = np.concatenate([x, x[:5]]).astype(np.int64)
    truth = np.cov(x.T, bias=True).reshape(d, d) * len(x)
    for cut in (0, 1, len(x) // 3):
        a, b = whitening.Spectrum.empty(d), whitening.Spectrum.empty(d)
        for v in x[:cut]:
            a.add(v)
        for v in x[cut:]:
            b.add(v)
        a.merge(b)
        size = max(np.abs(truth).max(), 1)
        assert a.n == len(x) and (a.sums == x.sum(0)).all() and (np.diff(a.lam) >= 0).all()
        assert np.abs(a.q.T @ a.q - np.eye(d)).max() < 1e-12 and np.abs(a.q @ np.diag(a.lam) @ a.q.T - truth).max() < 1e-11 * size
    c = whitening.Spectrum.empty(d)
    c.add(x[0], 4)
    c.add(x[1], 3)
    assert np.abs(c.q @ np.diag(c.lam) @ c.q.T - np.cov(np.array([x[0]] * 4 + [x[1]] * 3).T, bias=True).reshape(d, d) * 7).max() < 1e-9 * max(np.abs(truth).max(), 1)


def test_secular_equation():
    rng = np.random.default_rng(1)
    for m in (1, 2, 3, 40):
        for spread in (1.0, 1e-9, 1e6):
            d, w = np.cumsum(rng.random(m) * spread + spread * 1e-3), rng.normal(size=m) * 10.0 ** rng.integers(-6, 3, m)
            roots, away = whitening.secular_roots(d, w)
            assert np.abs(np.linalg.eigvalsh(np.diag(d) + np.outer(w, w)) - roots).max() <= 1e-12 * max(np.abs(d).max(), w @ w)
            assert (np.diagonal(away) < 0).all() and (m == 1 or (np.diagonal(away, 1) > 0).all())


def test_whitening(spark, some, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    got = whitening.whiten(vectors(spark, some)).toPandas()
    good = [(i, e) for i, e, _ in some if e is not None and None not in e and np.isfinite(e).all()]
    x = np.floor(1024 * np.array([e for _, e in good])).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    values, q = np.linalg.eigh(np.cov(x.T, bias=True))
    values, q = values[::-1], q[:, ::-1]
    want = (x - sums / n) @ q[:, :8] / np.sqrt(values[:8])
    assert len(got) == 8 * n and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    for k in range(8):
        own = got[got["component"] == k + 1]
        ids = sorted((str(i), d, round(abs(w), 6)) for (i, _), d, w in zip(good, ((n * x - sums) ** 2).sum(1), want[:, k]))
        assert sorted((str(None if pd.isna(i) else int(i)), d, round(abs(w), 6)) for i, d, w in zip(own["vec_id"], own["deviation"], own["whitened"])) == ids
        assert own["explained"].to_numpy() == pytest.approx(values[k] / values.sum(), rel=1e-10)
        one = own.dropna().drop_duplicates("vec_id").set_index("vec_id")["whitened"]
        assert abs(sum(np.sign(one[i] * w) for (i, _), w in zip(good, want[:, k]) if i is not None and abs(w) > 1e-6)) == sum(i is not None and abs(w) > 1e-6 for (i, _), w in zip(good, want[:, k]))
    # a first basis that is far off is led to the right one
    start = whitening.Spectrum(n, sums, values[::-1].copy(), np.linalg.qr(np.random.default_rng(0).normal(size=(12, 12)))[0])
    rows = whitening.integers(vectors(spark, some)).selectExpr("embedding v")
    monkeypatch.setattr(whitening, "SPARE", 1)
    assert whitening.refine(rows, start, 3)[0] == pytest.approx(values[:3], rel=1e-12)
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.25], 0)])).count() == 0 and whitening.whiten(vectors(spark, [])).count() == 0
    flat = whitening.whiten(vectors(spark, [(1, [0.5, 0.25], 0), (2, [0.25, 0.25], 0), (3, [0.25, 0.25], 0)])).toPandas()
    assert set(flat["component"]) == {1} and flat["explained"].iloc[0] == pytest.approx(1)
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(vectors(spark, [(1, [0.5], 0), (2, [0.5, 0.5], 0)]))


def plain_counts(data):
    """Triplet by triplet, in Python's integers."""
    out = [0] * 256
    data = b"\0" * 16 + data
    for i in range(16, len(data)):
        for k, (near, far) in enumerate(fingerprints.TRIPLETS):
            h = (data[i] | data[i - near] << 8 | data[i - far] << 16 | k << 24) * 0x9E3779B1 % 2**32
            h ^= h >> 15
            out[h * 0x85EBCA77 % 2**32 >> 24] += 1
    return out


def test_digests(monkeypatch):
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefghijklmñop ") for _ in range(random.randint(1, 9)))
    texts = ["", "a", "ab", *(" ".join(word() for _ in range(k)) for k in (5, 60, 400))]
    for t in texts:
        assert list(fingerprints.counts(t.encode())) == plain_counts(t.encode())
        assert fingerprints.likeness(fingerprints.digest(t), fingerprints.digest(t)) == 1
    whole = [list(fingerprints.counts(t.encode())) for t in texts]
    monkeypatch.setattr(fingerprints, "SLICE", 7)
    assert [list(fingerprints.counts(t.encode())) for t in texts] == whole
    level = [sum(c > sorted(whole[-1])[k] for k in (63, 127, 191)) for c in whole[-1]]
    assert list(fingerprints._levels(fingerprints.digest(texts[-1]))) == level
    far, near = " ".join(word() for _ in range(400)), texts[-1][:-40] + "something else"
    a, b, c = (fingerprints.digest(t) for t in (texts[-1], near, far))
    assert 0 <= fingerprints.likeness(a, c) < 0.5 < 0.8 < fingerprints.likeness(a, b) < 1 and fingerprints.likeness(a, b) == pytest.approx(fingerprints.likeness(b, a))
    assert fingerprints.likeness(fingerprints.digest(""), a) <= 0.5


@pytest.mark.parametrize("ranges", [1, 4])
def test_fingerprints(spark, monkeypatch, ranges):
    monkeypatch.setattr(fingerprints, "MAX_RANGES", ranges)
    random.seed(6)
    texts = [" ".join(random.choice(["uno", "два", "three", "四", "five"]) for _ in range(random.randint(1, 80))) for _ in range(60)] + [None, "", "x", "long " * 30000]
    rows = [(3 * i, t, "e", 1) for i, t in enumerate(texts)] + [(3, texts[1], "e", 1), (None, "no id", "e", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, again int").repartition(7)
    got = fingerprints.report(df).toPandas()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for k, (i, t, _, _) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + u[:h]
        a, e, b = (fingerprints.digest(x) for x in (t, edited, u))
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), e.hex(), fingerprints.likeness(a, e), fingerprints.likeness(a, b)))
    assert sorted((str(None if pd.isna(r[0]) else int(r[0])), *r[1:]) for r in got.itertuples(index=False)) == sorted(want)
    assert fingerprints.report(df.where("false")).count() == 0
    one = fingerprints.report(df.where("doc_id = 9")).first()
    assert one["near_next"] == 1 and one["n_chars"] == len(texts[3])
    pair = df.where("doc_id in (9, 12)").select(fingerprints.fingerprint("text").alias("f"))
    both = pair.selectExpr("max(f) a", "min(f) b").select(fingerprints.fingerprint_likeness("a", "b").alias("s")).first()["s"]
    assert both == pytest.approx(fingerprints.likeness(fingerprints.digest(texts[3]), fingerprints.digest(texts[4])))


def test_pairs_at_least():
    rng = np.random.default_rng(2)
    for d, scale in ((1, 5), (7, 50), (20, 9), (64, 60)):
        a, y = rng.integers(-scale, scale, (9, d)), rng.integers(-scale, scale, (300, d)) // rng.integers(1, 9, (300, 1))
        s = a @ y.T
        allowed = rng.random(s.shape) < 0.7
        for least in (np.full(9, -np.inf), np.quantile(s, rng.random(9)), np.full(9, float(s.max())), np.full(9, float(s.max()) + 1)):
            for ok in (None, allowed):
                i, j, got = negatives.pairs_at_least(a, least, y, ok)
                want = (s >= least[:, None]) & (True if ok is None else ok)
                assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(want))) and (got == s[i, j]).all()
    assert negatives.pairs_at_least(a[:0], np.zeros(0), y)[0].size == 0 and negatives.pairs_at_least(a, np.zeros(9), y[:0])[0].size == 0


def plain_negatives(rows):
    x = sorted({(i, (k + 1) % 10 if i is not None and i % 7 == 0 else k, tuple(int(np.floor(256 * c)) for c in e)) for i, e, k in rows if e is not None and k is not None and None not in e and np.isfinite(e).all()}, key=str)
    out = []
    last = lambda i: 2**63 if i is None else i
    for a in (r for r in x if r[0] is not None and r[0] % 100 == 0):
        s = [(int(np.dot(a[2], r[2])), r) for r in x if r is not a]
        for p, q in sorted((t for t in s if t[1][1] == a[1]), key=lambda t: (-t[0], last(t[1][0])))[:5]:
            fit = sorted((t for t in s if t[1][1] != a[1] and 80 * p <= 100 * t[0] <= 100 * p), key=lambda t: (-t[0], last(t[1][0])))[:5]
            out += [(a[0], q[0], k, r[0], p, t) for k, (t, r) in enumerate(fit, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [37, 8192])
def test_hard_negatives(spark, some, monkeypatch, block):
    """Many near copies, a label of its own, thresholds that have to fall to the end, null ids; in one block and many."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GROUP", 3)
    more = [*some, (1200, [-c for c in some[9][1]], 3), (1300, some[10][1], 99), (1400, [0.0] * 12, 2)]
    got = sorted(map(tuple, negatives.report(vectors(spark, more)).collect()), key=str)
    assert got == plain_negatives(more) and len({r[0] for r in got}) >= 5
    if block == 37:
        assert negatives.report(vectors(spark, [])).count() == 0 and negatives.report(vectors(spark, [(100, [1.0, 2.0], 1), (200, None, 1)])).count() == 0
        with pytest.raises(ValueError, match="entries"):
            negatives.report(vectors(spark, [(1, [0.5], 0), (2, [0.5, 0.5], 0)]))
        with pytest.raises(ValueError, match="exact"):
            negatives.report(vectors(spark, [(1, [1e9], 0), (2, [0.5], 0)]))
