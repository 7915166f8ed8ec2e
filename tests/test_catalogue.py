"""Each registered query beside its SQL, on whole tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from corelode.operators import multivariate
from corelode.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(name, spark, sf_dir, duck):
    got = _sorted(catalogue.queries()[name](spark, sf_dir).toPandas())
    want = _sorted(duck.sql(catalogue.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-7, atol=1e-6)


def test_sample_keeps_strata(spark, sf_dir):
    got = catalogue.queries()["representative_sample"](spark, sf_dir)
    assert {r[0] for r in got.select("l_returnflag").distinct().collect()} == {"A", "N", "R"}


def test_components_against_numpy(spark, sf_dir):
    columns = catalogue.PARTS
    table = pd.read_parquet(f"{sf_dir}/lineitem.parquet")[columns]
    values, vectors = np.linalg.eigh(table.corr().to_numpy())
    got = catalogue.queries()["pca_loadings"](spark, sf_dir).toPandas().set_index(["component", "column"])
    for k, value in enumerate(values[::-1], 1):
        want = vectors[:, -k] * np.sqrt(value)
        want = want if want[np.abs(want).argmax()] > 0 else -want
        assert np.allclose([got.loading[k, c] for c in columns], want, atol=1e-4)
        assert abs(got.variance_pct[k, columns[0]] - 25 * value) < 1e-3
    classes = catalogue.queries()["pca_classes"](spark, sf_dir).toPandas()
    high = classes["class"] == "high"
    assert 0.09 < high.mean() < 0.11 and classes.pc1[high].min() >= classes.pc1[~high].max()


def test_multivariate_odd_rows(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 3.0, 2.0), (5, 5.0, 2.0)], "id int, a double, b double")
    got = multivariate.mahalanobis(rows, ["a", "b"], 0.5).toPandas()
    assert got.id.tolist() == [1, 4, 5] and np.allclose(got.distance, [1, 0, 1])
    assert multivariate.mahalanobis(rows.limit(0), ["a", "b"], 1.0).count() == 0 and multivariate.pca_scores(rows.limit(0), ["a", "b"]).count() == 0
