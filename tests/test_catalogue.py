"""Every query with SQL agrees with it on the smallest tables."""

from __future__ import annotations

import warnings

import duckdb
import pytest

import __spark_entry__ as entry
from lattica import catalogue
from lattica.plans import selection

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    sort = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    got, want = sort(got), sort(want)
    assert len(got) == len(want)
    for c in columns:
        assert got[c].tolist() == want[c].tolist(), c


def test_manifold_reads_every_component(spark, tmp_path):
    """Vectors that differ only beyond their first 16 components are told apart."""
    rows = [(i, [(i // 10) * (d + 1) % 17 / 17 for d in range(16)] + [float(d % 10 == i % 10) + 0.001 * ((i * d) % 7) for d in range(48)], i % 10) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    label = {r.row_id: r.label for r in catalogue.fit_manifold(spark, str(tmp_path)).collect()}
    assert any(label[i] != label[j] for i in label for j in label if i // 10 == j // 10)


@pytest.mark.parametrize("name", ["fit_classification", "fit_regression", "fit_hidden", "fit_manifold", "predict_iterative", "score_samples", "select_init"])
def test_whole_models_are_fitted_to_tolerance(spark, monkeypatch, name):
    """Nothing shortens a fit or hides that it has not settled."""

    def asked(*args, **options):
        assert not {"max_iter", "tol"} & set(options)
        with pytest.warns(catalogue.N.ConvergenceWarning):
            warnings.warn("not settled", catalogue.N.ConvergenceWarning, stacklevel=1)
        raise StopIteration

    monkeypatch.setattr(catalogue.N, "fit", asked)
    monkeypatch.setattr(selection, "select", asked)
    with pytest.raises(StopIteration):
        catalogue.QUERIES[name](spark, SF)


def test_no_centre_vanishes(spark, tmp_path):
    spark.createDataFrame([(i, [float(i)], i) for i in range(1001)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    with pytest.raises(ValueError, match="labels"):
        catalogue.sqdist_matrix(spark, str(tmp_path))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
