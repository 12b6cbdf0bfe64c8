"""Whitening against numpy's eigenvectors, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from cutover.llm import whitening
from cutover.llm.queries import QUERIES

DDL = "vec_id long, embedding array<float>, label int"


def expected(vectors, k=whitening.COMPONENTS):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    known = np.unique(x, axis=0)
    n, s = len(known), known.sum(0)
    centred = (n * known - s) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:k]
    values, vectors = values[order], vectors[:, order]
    return n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ vectors / np.sqrt(values), values / np.trace(v)


def results(df):
    fit = whitening.fit(df)
    return fit, whitening.whitened(df, fit).collect()


def test_agrees_with_eigenvectors(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 24)) @ rng.normal(size=(24, 24)) * 0.2
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(500)]  # copies count once in the fit
    fit, out = results(spark.createDataFrame(rows, DDL).repartition(7))
    n, deviation, z, share = expected([r[1] for r in rows])
    assert fit.n == n == 300 and fit.identity_error < 1e-10
    assert np.allclose(fit.values / fit.trace, share, rtol=1e-12)
    by_id = {r.vec_id: r for r in out}
    assert [by_id[r[0]].deviation for r in rows] == deviation.tolist()
    got = np.array([by_id[r[0]].whitened for r in rows])
    assert np.abs(got - z * np.sign((got * z).sum(0))).max() < 1e-9


def test_factor_and_rotation():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(40, 40))
    v = a @ np.diag(10.0 ** -np.arange(0, 10, 0.25)) @ a.T
    factor = whitening.pivoted_cholesky(v)
    assert np.allclose(factor @ factor.T, v, rtol=0, atol=1e-12 * np.abs(v).max())
    f = whitening.rotated_columns(factor)
    gram = f.T @ f
    norms = np.sqrt(np.diag(gram))
    assert np.abs(gram / np.outer(norms, norms) - np.eye(len(gram))).max() < 1e-13
    # a matrix of lower rank has as many columns as its rank
    b = rng.normal(size=(12, 3))
    assert whitening.pivoted_cholesky(b @ b.T).shape == (12, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [1.0, None], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [-inf, 1.0], 0),
            (7, [0.5, 0.25], 0), (8, [0.5, 0.25], 0), (9, [-0.5, 1.0], 0), (10, [1.5, -1.0], 0), (11, [1.0, 2.0, 3.0], 0), (None, [0.0, 0.0], None)]
    df = spark.createDataFrame(rows, DDL)
    fit, out = results(df)
    assert fit.n == 4 and sorted((r.vec_id for r in out), key=repr) == [10, 7, 8, 9, None]
    assert np.allclose([r.whitened for r in out if r.vec_id == 7], [r.whitened for r in out if r.vec_id == 8], rtol=1e-9)
    clash = df.withColumns({c: F.lit("x") for c in ("Deviation", "whitened", "_x", "component", "n", "explained", "identity_error")})
    again = whitening.whitened(clash, fit)
    assert sorted((r.deviation for r in again.collect())) == sorted(r.deviation for r in out)
    listed = whitening.by_component(again, fit)
    assert listed.count() == 2 * len(out) and dict(listed.dtypes)["n"] == "bigint" and dict(listed.dtypes)["deviation"] == "bigint"


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], DDL)
    assert whitening.fit(empty) is None
    done = whitening.whitened(empty, None)
    assert whitening.by_component(done, None).collect() == []
    # equal vectors have no component
    fit, out = results(spark.createDataFrame([(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], DDL))
    assert fit.n == 1 and [r.whitened for r in out] == [[], []] and [r.deviation for r in out] == [0, 0]


def test_deviation_beyond_a_long(spark):
    fit = whitening.Whitening(3_000_000_000, (0, 0), np.eye(2), np.ones(2), 2.0, 0.0)
    assert [r.deviation for r in whitening.whitened(spark.createDataFrame([(1, [1.0, 1.0], 0)], DDL), fit).collect()] == [None]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    out = QUERIES["op11_embedding_whitening"](spark, folder)
    assert out.dtypes[:7] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, deviation, z, share = expected([r.embedding for r in rows])
    p = out.toPandas()
    assert len(p) == 16 * len(rows) and set(p.n) == {n} and p.identity_error.nunique() == 1 and p.identity_error.iloc[0] < 1e-4
    assert np.allclose(p.groupby("component").explained.first(), share, rtol=1e-10)
    assert p.groupby("vec_id").deviation.first().loc[[r.vec_id for r in rows]].tolist() == deviation.tolist()
    wide = p.pivot(index="vec_id", columns="component", values="whitened").loc[[r.vec_id for r in rows]].to_numpy()
    assert np.abs(np.abs(wide) - np.abs(z)).max() < 1e-6
