"""Medoids of a shard and the audit of found links."""

import numpy as np
import pytest

from corelode.llm import vector_graph


def test_medoids():
    draw = np.random.default_rng(1)
    centres = np.eye(6)
    x = np.repeat(centres, 20, axis=0) + draw.normal(size=(120, 6)) / 50
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = vector_graph.medoids(x, 6)
    assert sorted(got // 20) == list(range(6))
    for k in got:
        cell = x[k // 20 * 20 : k // 20 * 20 + 20]
        assert k % 20 == (cell @ cell.mean(axis=0)).argmax()
    assert len(vector_graph.medoids(np.ones((5, 1)), 16)) == 1 and len(vector_graph.medoids(np.zeros((0, 3)), 4)) == 0


def test_audit(spark):
    x = np.array([[1, 0], [0.9999, 0.01], [0, 1], [0.01, 0.9999], [1, 0.001]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, k // 4, v.tolist()) for k, v in enumerate(x)] + [(9, 0, [1.0])], "vec long, label int, x array<double>")
    links = [(0, 1), (1, 0), (2, 3), (3, 2)]
    told = lambda some: spark.createDataFrame(some, "src long, dst long")
    assert vector_graph.audit(rows, told(links)) == 1 and vector_graph.audit(rows, told(links[:1])) == pytest.approx(0.25)
    assert vector_graph.audit(rows.limit(0), told(links)) == 1 and vector_graph.audit(rows.where("vec in (0, 2)"), told(links[:1])) == 1


def test_audited_query(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(40, 16))
    x = np.concatenate([base + draw.normal(size=base.shape) / 60 for _ in range(5)])
    df = spark.createDataFrame([(k, v.tolist(), k % 40 % 2) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = vector_graph.near_duplicates(df).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    same = (unit @ unit.T >= 0.98) & (np.arange(200)[:, None] % 40 % 2 == np.arange(200)[None] % 40 % 2) & ~np.eye(200, dtype=bool)
    assert (got.sort_values("vec_id").n_links.to_numpy() == same.sum(axis=1)).all() and (got.audited_recall == 1).all()
