"""Vector codes against plain Lloyd in Python's integers, whitening against fractions; what both do with odd rows."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tidewatch.llm import vector_codes, vectors, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, code string, error string, component string, n string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, label, "x", "c", "e", "k", "n") for i, v, label in rows], SCHEMA).repartition(parts)


def usable(rows):
    ok = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    lengths = [len(v) for _, v, _ in ok]
    dims = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    return [r for r in ok if len(r[1]) == dims], dims


def plain_codes(rows, parts, entries, rounds, scale):
    """Codes, errors, label errors and the codebooks' digest by comparing everything with everything."""
    rows, dims = usable(rows)
    q = [[math.floor(Fraction(c) * scale) for c in v] for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, np.array(q[i], "<i8").tobytes()))[:entries]
    at = [dims * k // parts for k in range(parts + 1)]
    books = [[q[i][a:b] for i in first] for a, b in zip(at, at[1:], strict=False)]
    far = lambda p, e: sum((x - y) ** 2 for x, y in zip(p, e, strict=True))

    def nearest():
        return [[min((far(v[a:b], e), j) for j, e in enumerate(book)) for book, a, b in zip(books, at, at[1:], strict=False)] for v in q]

    for _ in range(rounds):
        near = nearest()
        for k, book in enumerate(books):
            for j in range(len(book)):
                own = [v[at[k] : at[k + 1]] for v, n in zip(q, near, strict=True) if n[k][1] == j]
                if own:
                    book[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    near = nearest()
    error = [sum(d for d, _ in n) for n in near]
    of = {}
    for (_, _, label), e in zip(rows, error, strict=True):
        of[label] = of.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{j:02x}" for _, j in n), e, of[label], digest) for (i, _, label), n, e in zip(rows, near, error, strict=True)], key=str)


def random_rows(seed, n, dims, spread=0.2, clusters=7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    return [(int(i), (centres[i % clusters] + spread * rng.normal(size=dims)).tolist(), None if i % 11 == 0 else int(i % 3)) for i in range(n)]


ODD = [(900, None, 1), (901, [], 1), (902, [1.0, None] * 4, 1), (903, [float("nan")] * 8, 2), (904, [float("inf")] * 8, 2), (905, [1.0] * 5, 2), (None, [0.5] * 8, 2), (None, [-0.5] * 8, None), (3, [0.25] * 8, 0), (906, [0.0] * 8, 0)]


@pytest.mark.parametrize(("dims", "entries", "scale"), [(8, 32, 1024), (8, 40, 3), (10, 16, 7), (3, 20, 50)])
def test_codes_by_plain_lloyd(spark, dims, entries, scale):
    """Small scales make most distances ties; ten components and three don't divide by four."""
    rows = random_rows(dims + scale, 300, dims) + (ODD if dims == 8 else [])
    rows += rows[:5]
    got = vector_codes.code_report(table(spark, rows), 4, entries, 4, scale)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_codes(rows, 4, entries, 4, scale)


def test_codes_of_very_large_components(spark):
    """Beyond what 64-bit sums hold, distances are Python's integers; errors and sums that don't fit are null."""
    rows = [(i, [(-1) ** i * 2.0**k * (i + 1) for k in (0, 20, 40, 44)], i % 2) for i in range(30)]
    want = plain_codes(rows, 4, 8, 3, 1024)
    got = sorted(map(tuple, vector_codes.code_report(table(spark, rows), 4, 8, 3, 1024).collect()), key=str)
    short = lambda e: e if e < 1 << 63 else None
    assert [g[:3] for g in got] == [(i, c, short(e)) for i, c, e, _, _ in want] and {g[4] for g in got} == {want[0][4]}
    assert any(g[2] is None for g in got) and any(g[2] is not None for g in got)


def test_bounds_skip_groups_and_stay_below():
    """Over rounds of moving entries, bounds never exceed the distances they stand for, and most distances are skipped."""
    rng = np.random.default_rng(4)
    points = (rng.normal(size=(3000, 16)) + 6 * rng.integers(0, 2, (3000, 16))).__mul__(200).astype(np.int64)
    entries = points[:256].copy()
    book = vector_codes.Codebook(entries, vector_codes.grouped(entries), np.zeros(16))
    assert sorted(np.concatenate(book.groups)) == list(range(256))
    code, bounds, share = np.zeros(3000, np.int64), np.full((3000, len(book.groups)), -np.inf), []
    for _ in range(6):
        code, bounds, own, taken = vector_codes.assign(points, book, code, vector_codes._down(bounds))
        exact = ((points[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
        assert (code == exact.argmin(axis=1)).all() and (own == exact.min(axis=1)).all()
        others = np.sqrt(exact.astype(float))
        others[np.arange(3000), code] = np.inf
        assert all((bounds[:, g] <= others[:, m].min(axis=1, initial=np.inf) * (1 + 1e-9)).all() for g, m in enumerate(book.groups))
        share.append(taken / exact.size)
        counts, sums = vector_codes._totals(points, code, 256)
        book = vector_codes.replaced(book, counts.tolist(), sums.tolist())
    assert share[0] > 0.99 and max(share[3:]) < 0.5


def test_codes_salted_and_empty(spark, monkeypatch):
    rows = random_rows(1, 60, 8)
    want = plain_codes(rows, 4, 16, 2, 100)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    assert sorted(map(tuple, vector_codes.code_report(table(spark, rows), 4, 16, 2, 100).collect()), key=str) == want
    assert vector_codes.code_report(table(spark, []), 4).collect() == [] and vector_codes.code_report(table(spark, ODD[:2]), 4).collect() == []


def plain_whitening(rows, scale, offset):
    """n, exact deviations by row, and the covariance as fractions."""
    rows, dims = usable(rows)
    x = [[math.floor(Fraction(c) * scale) + offset for c in v] for _, v, _ in rows]
    n = len(x)
    s = [sum(c) for c in zip(*x, strict=True)]
    z = [[n * c - t for c, t in zip(v, s, strict=True)] for v in x]
    cov = [[Fraction(sum(v[i] * v[j] for v in z), n**3) for j in range(dims)] for i in range(dims)]
    return rows, n, [sum(c * c for c in v) for v in z], cov, np.array([[float(Fraction(c, n)) for c in v] for v in z])


def held(got):
    """deviation by vec_id, and the matrix of whitened values in their order."""
    rows = sorted(got.collect(), key=lambda r: (r["vec_id"], r["component"]))
    ids = sorted({r["vec_id"] for r in rows})
    return rows, ids, np.array([r["whitened"] for r in rows]).reshape(len(ids), -1)


@pytest.mark.parametrize(("dims", "scale"), [(8, 64), (40, 64), (5, 3)])
def test_whitening_by_fractions(spark, dims, scale):
    rows = random_rows(dims, 120, dims) + [r for r in ODD if r[0] is not None and r[0] >= 900 and dims == 8]
    rows, n, dev, cov, centred = plain_whitening(rows, scale, 1_000_000)
    got = whitening.whiten(table(spark, rows + [(950, None, 0), (951, [1.0, None], 0)]), scale, 1_000_000, 32)
    out, ids, w = held(got)
    k = min(dims, 32)
    assert ids == sorted(r[0] for r in rows) and w.shape == (n, k) and {r["n"] for r in out} == {n}
    order = np.argsort([r[0] for r in rows])
    assert [r["deviation"] for r in out[::k]] == [dev[i] for i in order]
    v = np.array([[float(c) for c in row] for row in cov])
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    assert [r["explained"] for r in out[:k]] == pytest.approx((e[:k] / np.trace(v)).tolist(), rel=1e-9)
    want = centred[order] @ axes[:, :k] / np.sqrt(e[:k])
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-7
    error = {r["identity_error"] for r in out}
    assert len(error) == 1 and max(error) < 1e-9
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9


def test_whitening_of_uneven_scales(spark):
    """One dimension ten million times as wide as the others: its rounding would drown them."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(1e7 * v[0]), *(v[1:] + 0.1 * v[0]).tolist()], 0) for i, v in enumerate(rng.normal(size=(200, 6)))]
    _, n, dev, cov, _ = plain_whitening(rows, 64, 1_000_000)
    out, _, w = held(whitening.whiten(table(spark, rows), 64, 1_000_000, 32))
    assert [r["deviation"] for r in out[::6]] == [d if d < 1 << 63 else None for d in dev]
    assert max(r["identity_error"] for r in out) < 1e-4 and np.abs(w.T @ w / n - np.eye(6)).max() < 1e-4
    # the other five: the Schur complement's eigenvalues, which the large dimension only shifts by a ten-billionth
    rest = np.array([[float(cov[i][j] - cov[i][0] * cov[0][j] / cov[0][0]) for j in range(1, 6)] for i in range(1, 6)])
    trace = float(sum(cov[i][i] for i in range(6)))
    assert [r["explained"] for r in out[1:6]] == pytest.approx((np.linalg.eigvalsh(rest)[::-1] / trace).tolist(), rel=1e-4)


def test_digit_slices_are_exact():
    rng = np.random.default_rng(1)
    for bits in (8, 21, 40, 61):
        y = rng.integers(-(1 << bits), 1 << bits, (500, 5))
        assert sum(a.astype(np.int64).astype(object) * (1 << (whitening.LIMB * i)) for i, a in enumerate(whitening.limbs(y))).tolist() == y.tolist()
        assert whitening.products(y).tolist() == (y.astype(object).T @ y.astype(object)).tolist()


def test_whitening_without_variance(spark):
    """Repeated rows, one row, a constant dimension: components without variance are 0, the others still white."""
    rows = [(i, [float(i % 2), 3.0, float(i % 5)], 0) for i in range(20)] + [(None, [1.0, 3.0, 1.0], 0)]
    out = whitening.whiten(table(spark, rows)).collect()
    assert len(out) == 63 and {r["component"] for r in out} == {1, 2, 3} and all(r["whitened"] == 0 and r["explained"] < 1e-15 for r in out if r["component"] == 3)
    assert max(r["identity_error"] for r in out) < 1e-9
    one = whitening.whiten(table(spark, [(7, [1.0, 2.0], None)])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, 0.0, 0.0, 0.0)] * 2
    assert whitening.whiten(table(spark, [])).collect() == []


def test_usable_vectors(spark):
    t = table(spark, ODD)
    assert vectors.common_length(t, "embedding") == 8 and vectors.common_length(t.limit(0), "embedding") == 0
