"""Queries without SQL cover whole vectors and whole tables, against numpy."""

import numpy as np
import pandas as pd
import pytest

from sigmill.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def embeddings():
    e = pd.read_parquet(f"{DATA}/embeddings.parquet").sort_values("vec_id")
    return e.vec_id.to_numpy(), np.array(e.embedding.tolist(), float), np.where(e.label % 2 == 0, 1.0, -1.0)


def column(df, name):
    return np.array([r[name] for r in df.orderBy("id").collect()], float)


def test_qda_reads_whole_vectors(spark, embeddings):
    i, x, y = embeddings
    score = 0
    for sign in (1, -1):
        own = x[(i % 2 == 0) & (y == sign)]
        cov = np.cov(own.T, bias=True)
        cov += 1e-3 * np.trace(cov) / len(cov) * np.eye(len(cov))
        z = x - own.mean(0)
        score = score + sign * (np.log(len(own)) - (np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) + np.linalg.slogdet(cov)[1]) / 2)
    assert np.allclose(column(QUERIES["qda"](spark, DATA), "score"), score, atol=1e-4)


def test_linear_svm_reads_whole_vectors(spark, embeddings):
    i, x, y = embeddings
    design, train = np.hstack([x, np.ones((len(x), 1))]), i % 2 == 0
    s = column(QUERIES["linear_svm"](spark, DATA), "score")
    w = np.linalg.lstsq(design, s, rcond=None)[0]
    assert np.allclose(design @ w, s, atol=1e-4)
    gap = np.maximum(0, 1 - y[train] * (design[train] @ w))
    assert abs(w - 2 * design[train].T @ (gap * y[train])).max() < 1e-2  # the gradient at the optimum, from scores of five digits
    assert (abs(w[:-1]) > 1e-3).sum() > 16


def test_ica_reads_whole_vectors(spark, embeddings):
    _, x, _ = embeddings
    p = column(QUERIES["ica"](spark, DATA), "projected")
    z = x - x.mean(0)
    value, base = np.linalg.eigh(np.cov(x.T, bias=True))
    top = base[:, np.argsort(-value)[:3]]
    f = np.linalg.lstsq(x, p, rcond=None)[0]
    assert np.allclose(x @ f, p, atol=1e-3) and np.allclose(top @ (top.T @ f), f, atol=1e-2 * abs(f).max())  # filters in the leading space of all components
    white = z @ f
    assert np.allclose(white.T @ white / len(x), np.eye(3), atol=1e-3)
    g = np.tanh(white)
    step = white.T @ g / len(x) - np.diag((1 - g * g).mean(0))
    u, _, v = np.linalg.svd(step)
    assert np.allclose(abs(np.diag(u @ v)), 1, atol=1e-4)  # another round doesn't move them


def test_xdawn_covers_all_rows(spark):
    lines = pd.read_parquet(f"{DATA}/lineitem.parquet")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    lines = lines.sort_values(order).assign(t=lambda x: x.groupby("l_orderkey").cumcount() + 1)
    x = lines[["l_quantity", "l_extendedprice", "l_discount", "l_tax"]].to_numpy(float)
    got = QUERIES["xdawn"](spark, DATA).toPandas().sort_values(["win", "t"])
    assert got[["win", "t"]].to_numpy().tolist() == lines[["l_orderkey", "t"]].to_numpy().tolist()
    evoked = lines.assign(**{f"x{k}": x[:, k] for k in range(4)})[lines.l_returnflag == "A"].groupby("t")[[f"x{k}" for k in range(4)]].agg("mean").to_numpy()
    n = lines[lines.l_returnflag == "A"].groupby("t").size().to_numpy()
    value, base = np.linalg.eigh(x.T @ x)
    white = base / np.sqrt(np.maximum(value, 1e-12 * value.max()))  # the operator's own floor, for channels of very different size
    order, rotate = np.linalg.eigh(white.T @ (evoked.T @ (evoked * n[:, None])) @ white)
    want = x @ white @ rotate[:, np.argsort(-order)[:2]]
    c = got[["c0", "c1"]].to_numpy()
    assert np.allclose(c * np.sign((c * want).sum(0)), want, atol=2e-4)
