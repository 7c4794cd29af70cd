"""Plans of raster queries at sizes that Spark can't tell from the tables: exploded pixels aren't in its estimates."""

import numpy as np
import pytest

from rasterel.operators import kernels, palettes
from rasterel.operators import pixels as px
from rasterel.plans import registry


@pytest.mark.parametrize("name", ["component_count_by_runs", "lloyd_round", "lloyd_refine", "sheet_slice_cell", "corner_background_mask", "neighbour_pairs"])
def test_pixels_are_not_broadcast(spark, sf_dir, name):
    assert "BroadcastExchange" not in registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_lloyd_rounds_read_each_table_once(spark):
    colors = spark.createDataFrame([(1, 3, 0.5, 0.1, 0.0), (1, 1, 0.9, 0.0, 0.0), (2, 1, 0.2, 0.0, 0.1)], "image_id long, n long, ok_l double, ok_a double, ok_b double")
    palette = spark.createDataFrame([(1, 0, 10, 20, 30), (1, 1, 200, 210, 220), (2, 0, 0, 0, 0)], "image_id long, idx int, r int, g int, b int")
    plan = palettes.lloyd_refined(colors, palette, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert palettes.lloyd_refined(colors, palette, 0).count() == 3


def test_pairs_of_repeated_points_and_none_without_image(spark):
    points = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 1, 0), (1, 5, 5), (None, 0, 0), (None, 1, 0)], "image_id long, x int, y int")
    got = sorted(tuple(r) for r in px.neighbour_pairs(points).collect())
    assert got == [(1, 0, 0, 1, 0)] * 2 + [(1, 1, 0, 0, 0)] * 2


@pytest.mark.parametrize("name", ["skin_face_bbox", "heuristic_features", "kcentroid_cells"])
def test_images_are_computed_many_at_once(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "BroadcastExchange" not in plan
    assert plan.count("CBRT") <= 6  # three roots a pixel and projection, faces and eyes


def test_canvases_keep_images_apart():
    rng = np.random.default_rng(5)
    masks = [rng.random((h, w)) < 0.5 for h, w in [(1, 1), (3, 9), (8, 2), (30, 30), (2, 2)]]
    masks = [m for m in masks if m.any()]
    y, x = (np.concatenate([np.nonzero(m)[k] for m in masks]) for k in (0, 1))
    start = np.concatenate([[0], np.cumsum([m.sum() for m in masks])])
    for most in (1, 200, 1 << 18):
        got = []
        for p, row, col, shape in kernels.canvases(x - 4, y - 7, start, most):
            drawn = np.zeros(shape, bool)
            drawn[row, col] = True
            got += (kernels.label(drawn)[row, col] - row * shape[1] - col).tolist()  # how far before a pixel its label is
            assert drawn.sum() == p.stop - p.start
        assert sum(v == 0 for v in got) == sum(len(np.unique(kernels.label(m)[m])) for m in masks) and len(got) == len(x)


def test_cleanup_sorts_images_once(spark, sf_dir):
    plan = registry.queries()["cleanup_converged"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 0 and plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("k", [1, 2, 5])
def test_centres_of_many_cells_are_those_of_each(k):
    rng = np.random.default_rng(7)
    n = np.array([1, 2, 3, 40, 5, 1])
    lab, weight, start = rng.random((n.sum(), 3)), rng.random(n.sum()), np.concatenate([[0], np.cumsum(n)])
    got = kernels.kcentroids(lab, weight, start, k)
    assert np.allclose(got, [kernels.kcentroid(lab[a:b], weight[a:b], k) for a, b in zip(start, start[1:])], rtol=0, atol=1e-12)
