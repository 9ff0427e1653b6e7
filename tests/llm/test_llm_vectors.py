"""Whitening and vector codes against plain numpy, on small and awkward tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenmill.llm import vector_codes, whitening
from tokenmill.llm import queries
from tokenmill import inputs

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x long, m long, row string, near int, whitened int"


def table(spark, vectors, labels=None, ids=None):
    n = len(vectors)
    rows = [((ids or range(n))[i], v, (labels or [None] * n)[i], 1, 2, "r", 3, 4) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def random_vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(0.2, 1.5, d)).astype(np.float32).tolist()


BAD = [None, [1.0, None, 0.0, 0.0], [float("nan"), 0.0, 0.0, 0.0], [0.0, float("inf"), 0.0, 0.0], [0.0, 0.0, float("-inf"), 0.0]]


def plain_whitening(vectors, k):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    d = x - s / n
    v = d.T @ d / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:k]
    return x, n, s, d, v, e[order], u[:, order]


def check_whitened(rows, vectors, ids, k):
    x, n, s, d, v, e, u = plain_whitening(vectors, k)
    at = {i: j for j, i in enumerate(ids)}
    assert len(rows) == len(vectors) * len(e)
    signs = {}
    for r in rows:
        j, c = at[r.row["vec_id"]], r.component - 1
        want = d[j] @ u[:, c] / np.sqrt(e[c])
        if abs(want) > 1e-3:
            sign = signs.setdefault(c, np.sign(want * r.whitened))
            assert abs(sign * r.whitened - want) < 1e-6
        assert r.n == n and r.deviation == sum(int(n * a - b) ** 2 for a, b in zip(x[j].tolist(), s.tolist()))
        assert abs(r.explained - e[c] / np.trace(v)) < 1e-9 and r.identity_error < 1e-8
    assert len(signs) == len(e)


def test_whitening_equals_a_plain_one(spark):
    vectors = random_vectors(60, 12)
    rows = whitening.whiten(table(spark, vectors + BAD_12), ["vec_id"]).collect()
    check_whitened(rows, vectors, range(60), 8)


BAD_12 = [None if v is None else v * 3 for v in BAD]


def test_copies_weigh_as_many_rows_and_are_whitened_once(spark):
    vectors = random_vectors(20, 4, 1)
    vectors += [vectors[3]] * 40 + [vectors[5]] * 2
    rows = whitening.whiten(table(spark, vectors + BAD), ["vec_id"]).collect()
    check_whitened(rows, vectors, range(62), 8)
    by = {(r.row["vec_id"], r.component): r.whitened for r in rows}
    assert len({by[i, 1] for i in [3, *range(20, 60)]}) == 1
    once = whitening.whiten(table(spark, vectors), ["vec_id"], weights="one").collect()
    fit = plain_whitening(vectors[:20], 8)
    assert all(r.n == 20 for r in once) and len(once) == 62 * 4
    assert abs([r for r in once if r.component == 1][0].explained - fit[5][0] / np.trace(fit[4])) < 1e-9


def test_whitening_of_nothing_of_one_and_of_large_numbers(spark):
    columns = ["row", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for vectors in ([], BAD, [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]]):
        got = whitening.whiten(table(spark, vectors), ["vec_id"])
        assert got.columns == columns and got.count() == 0
    flat = whitening.whiten(table(spark, [[1.0, 0.0], [1.0, 1.0], [1.0, 3.0]]), ["vec_id"]).collect()
    assert {r.component for r in flat} == {1}  # the other has no variance
    big = whitening.whiten(table(spark, [[2.0**40, 0.0], [0.0, 2.0**41]]), ["vec_id"]).collect()
    assert len(big) == 2 and all(r.deviation is None for r in big)
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, [[1.0], [1.0, 2.0]]), ["vec_id"])


def test_whitening_with_null_and_repeated_keys(spark):
    vectors = random_vectors(10, 4, 2)
    rows = whitening.whiten(table(spark, vectors, ids=[None, None, 1, 1, 1, 2, 3, 4, 5, 6]), ["vec_id", "row"]).collect()
    assert len(rows) == 40 and sum(r.row["vec_id"] is None for r in rows) == 8


def test_whitening_query_over_its_whole_table(spark):
    got = queries.QUERIES["op11_whiten_vectors"](spark, SF).toPandas()
    e = inputs.table(spark, SF, "embeddings").orderBy("vec_id").toPandas()
    keep = [i for i, v in zip(e.vec_id, e.embedding) if v is not None and np.isfinite(np.array(v, np.float64)).all()]
    v = [list(x) for i, x in zip(e.vec_id, e.embedding) if i in set(keep)]
    x, n, s, d, cov, eig, u = plain_whitening(v, 8)
    assert len(got) == 8 * n and set(got.vec_id) == set(keep) and (got.n == n).all()
    first = got[got.component == 1].set_index("vec_id").whitened.reindex(keep).to_numpy()
    want = d @ u[:, 0] / np.sqrt(eig[0])
    assert min(np.abs(first - want).max(), np.abs(first + want).max()) < 1e-8


# ---- vector codes --------------------------------------------------------------------

def plain_codes(vectors, ids, parts=4, entries=256, rounds=4):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64)
    order = sorted(range(len(x)), key=lambda i: (ids[i] is None, ids[i] or 0, x[i].tolist()))[:entries]
    p = x.reshape(len(x), parts, -1)
    books = np.stack([p[order, k] for k in range(parts)])

    def assign():
        d = ((p[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(-1), d.min(-1)

    for _ in range(rounds):
        at, _ = assign()
        for k in range(parts):
            for j in range(books.shape[1]):
                if (at[:, k] == j).any():
                    books[k, j] = p[at[:, k] == j, k].sum(0) // (at[:, k] == j).sum()
    at, d = assign()
    codes = ["".join(f"{c:02x}" for c in row) for row in at]
    return codes, d.sum(1).tolist(), hashlib.sha256(",".join(map(str, books.reshape(-1))).encode()).hexdigest()


@pytest.mark.parametrize("n,d,entries,pivots", [(300, 16, 256, 8), (300, 8, 16, 3), (40, 4, 256, 8), (50, 12, 5, 1), (9, 8, 3, 8)])
def test_codes_equal_an_exhaustive_search(spark, n, d, entries, pivots):
    vectors = random_vectors(n, d, n)
    vectors = vectors + [vectors[1]] * 7 + [[0.0] * d] * 3  # ties and copies
    ids = list(range(len(vectors)))
    coded, books = vector_codes.compress(table(spark, vectors, ids=ids), "vec_id", entries=entries, pivots=pivots)
    codes, errors, sha = plain_codes(vectors, ids, entries=entries)
    got = {r.row["vec_id"]: (r.code, r.error) for r in coded.collect()}
    assert got == {i: (c, e) for i, c, e in zip(ids, codes, errors)}
    assert books.sha256() == sha


def test_pruning_spares_exact_distances():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (64, 8))
    entries = centres + rng.integers(-20, 20, centres.shape)
    x = centres[rng.integers(0, 64, 500)] + rng.integers(-50, 50, (500, 8))
    pivots = vector_codes.farthest_first(entries, 8)
    d = vector_codes.distances
    at, best, evaluated = vector_codes.nearest(x, d(x, pivots), entries, d(pivots, entries))
    exact = ((x[:, None] - entries[None]) ** 2).sum(-1)
    assert (at == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert evaluated < 0.35 * exact.size


def test_codes_of_awkward_tables(spark):
    vectors = random_vectors(6, 4, 9)
    ids = [None, 3, 3, 1, None, 2] + [None] * len(BAD)
    labels = [1, None, None, 2, 1, 2] + [1] * len(BAD)
    coded, books = vector_codes.compress(table(spark, vectors + BAD, labels, ids), "vec_id", keep=["label", "row"])
    codes, errors, sha = plain_codes(vectors, ids[:6])
    got = vector_codes.group_errors(coded, "label").collect()
    assert sorted((r.code, r.error) for r in got) == sorted(zip(codes, errors)) and books.sha256() == sha
    sums = {}
    for lab, e in zip(labels, errors):
        sums[lab] = sums.get(lab, 0) + e
    assert all(r.group_error == sums[r.row["label"]] for r in got) and {r.row["row"] for r in got} == {"r"}
    for nothing in ([], BAD):
        coded, books = vector_codes.compress(table(spark, nothing), "vec_id", keep=["label"])
        assert vector_codes.group_errors(coded, "label").count() == 0 and books.sha256() == hashlib.sha256(b"").hexdigest()
    for wrong in ([[1.0, 2.0, 3.0]], [[1.0] * 4, [1.0] * 8], [[3e6, 0.0, 0.0, 0.0]]):
        with pytest.raises(ValueError):
            vector_codes.compress(table(spark, wrong), "vec_id")


def test_codes_query_equals_its_sql(spark):
    from oracle import compare
    s, d = compare(spark, "op12", queries.QUERIES["op12_vector_codes"], queries.ORACLE["op12_vector_codes"], "/root/testdata/sf0.01")
    assert s == d and s[0] > 0
