"""Nearest neighbours by cells against the full scan."""

import numpy as np
import pytest

from tessera.operators import cells, retrieval


def table(spark, x, notes):
    rows = [(f"n{n}", f"c{i:04d}", "s", [float(v) for v in r]) for i, (r, n) in enumerate(zip(x, notes, strict=True))]
    return spark.createDataFrame(rows, "note_id string, chunk_id string, section_path string, embedding array<float>")


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c, 0.3, (80, 6)) for c in r.uniform(-9, 9, (12, 6))]).astype(np.float32)
    x[5:25] = x[4]  # ties
    df = table(spark, x, r.integers(0, 200, len(x))).repartition(4).cache()
    folder = str(tmp_path_factory.mktemp("cells"))
    cells.write_cells(df, folder, 12)
    return df, x, folder


def rows(df):
    return sorted((r["rank"], r["note_id"], r["chunk_id"], r["relevance"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 100])
def test_answers_are_those_of_a_full_scan(spark, clustered, k):
    df, x, folder = clustered
    shares = []
    for q in (x[4], x[400], x[700] + 0.2, np.zeros(6), np.full(6, 50.0)):
        found = cells.nearest(spark, folder, q.tolist(), k)
        assert rows(found.ranked) == rows(retrieval.vector_layer(df, q.tolist(), k))
        shares.append(found.read / found.cells)
    assert k == 100 or min(shares) <= 0.25


def test_only_the_cells_that_count_are_scanned(spark, clustered):
    _, x, folder = clustered
    found = cells.nearest(spark, folder, x[400].tolist(), 3)
    plan = found.ranked._jdf.queryExecution().executedPlan().toString()
    assert found.read < found.cells and "PartitionFilters: [isnotnull(cell" in plan.replace("\n", "") or "PartitionFilters: [cell" in plan


def test_few_vectors_and_none(spark, tmp_path):
    df = table(spark, np.eye(3), [0, 1, 1])
    cells.write_cells(df, str(tmp_path / "a"), 64)
    found = cells.nearest(spark, str(tmp_path / "a"), [1.0, 0.0, 0.0], 10)
    assert rows(found.ranked) == rows(retrieval.vector_layer(df, [1.0, 0.0, 0.0], 10)) and found.read == found.cells
    cells.write_cells(df.where("false"), str(tmp_path / "b"))
    assert cells.nearest(spark, str(tmp_path / "b"), [1.0], 5).ranked.collect() == []
