"""Facts about small hand-made rasters."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterel.operators import kernels as k
from rasterel.operators import sheets
from rasterel.plans.convert import convert_image, grid_of
from rasterel.plans.profile import preset

RED, BLUE = (220, 40, 40, 255), (40, 40, 220, 255)


def image(w, h, color=(0, 0, 0, 0)):
    return np.full((h, w, 4), color, np.uint8)


def full(img):
    return np.ones(img.shape[:2], bool)


def test_alpha_threshold():
    img = image(2, 1)
    img[0, :, 3] = (50, 200)
    assert k.foreground(img, 96, 24)[0].tolist() == [[False, True]]


def test_components_of_a_split_mask():
    mask = np.array([[1, 0, 0, 0, 1]], bool)
    assert len(k.components(mask)) == 2
    pair = np.array([[1, 0, 1, 1, 0]], bool)
    assert k.without_small(pair, 2).tolist() == [[False, False, True, True, False]]
    assert k.without_small(pair, 1).tolist() == pair.tolist()


def test_corner_background():
    img = image(3, 3, (255, 255, 255, 255))
    img[1, 1, :3] = 0
    mask, source = k.foreground(img, 96, 24)
    assert source == "corner-background" and mask.sum() == 1 and mask[1, 1]


def test_bounding_box():
    mask = np.zeros((10, 10), bool)
    assert k.bounding_box(mask) is None
    mask[4, 3] = mask[8, 7] = True
    assert k.bounding_box(mask) == (3, 4, 8, 9)


@pytest.mark.parametrize("mode", ["mode", "k-centroid"])
def test_majority_of_a_row(mode):
    img = image(10, 1, RED)
    img[0, 6:] = BLUE
    cells, coverage = k.sample(img, full(img), (0, 0, 10, 1), (1, 1), mode, 2, img[..., 3] / 255)
    assert coverage[0, 0] == 1
    assert cells[0, 0].tolist() == list(RED) if mode == "mode" else cells[0, 0, 0] > 200 and cells[0, 0, 2] < 60


def test_ties_go_to_the_lower_colour():
    img = image(2, 1, (10, 10, 10, 255))
    img[0, 1, :3] = 200
    cells, _ = k.sample(img, full(img), (0, 0, 2, 1), (1, 1), "mode", 2, img[..., 3] / 255)
    assert cells[0, 0].tolist() == [10, 10, 10, 255]


def test_exact_palette_and_cut():
    codes = k.packed(np.array([[9, 9, 9], [1, 2, 3], [200, 0, 0]]))
    empty = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
    rows = k.histogram(codes, np.ones(3))
    assert k.palette_of(empty, rows, 8).tolist() == sorted(codes.tolist())
    assert len(k.palette_of(empty, rows, 2)) == 2
    assert len(k.palette_of(empty, empty, 8)) == 0


def test_weights_win_a_palette_entry():
    codes = np.r_[np.full(90, k.packed(np.array([230, 230, 230]))), np.full(10, k.packed(np.array([20, 20, 20])))]
    colors = k.unpacked(k.median_cut(*k.histogram(codes, np.r_[np.ones(90), np.full(10, 8.0)]), 2))
    assert (colors[:, 0] < 90).sum() == 1 and (colors[:, 0] > 180).sum() == 1


def test_budget_of_one_with_critical_pixels_gives_two():
    rows = [k.histogram(k.packed(np.array([[c, c, c], [c + 9, c, c]])), np.ones(2)) for c in (10, 200)]
    assert len(k.palette_of(rows[0], rows[1], 1)) == 2


def test_critical_pixels_keep_a_colour():
    img = image(32, 32, (240, 235, 220, 255))
    img[:, :, 2] -= np.arange(32, dtype=np.uint8)
    img[10:14, 10:14, :3] = (222, 170, 130)
    critical, _ = k.feature_maps((32, 32), [("face", 10, 10, 14, 14, 0.6)])
    codes = k.packed(img)
    colors = k.unpacked(k.palette_of(k.histogram(codes[critical], np.ones(16)), k.histogram(codes[~critical], np.ones(1008)), 4))
    assert any(c[0] > 190 and c[2] < 160 for c in colors.tolist())


def test_posterizing_a_ramp():
    img = image(16, 1, (0, 0, 0, 255))
    img[0, :, :3] = (np.arange(16) * 17)[:, None]
    assert len(np.unique(k.packed(k.posterize(img, full(img), 3)))) <= 3
    assert (k.posterize(img, full(img), 1) == img).all()


def test_orphans():
    img = image(5, 5, RED)
    img[2, 2] = BLUE
    out, n = k.merge_orphans(img, full(img), None)
    assert n == 1 and (out == RED).all()
    lock = np.zeros((5, 5), bool)
    lock[2, 2] = True
    assert k.merge_orphans(img, full(img), lock)[1] == 0
    img[2, 3] = BLUE
    assert k.merge_orphans(img, full(img), None)[1] == 0


def test_jaggies():
    img = image(6, 5, RED)
    img[:, 3:] = BLUE
    img[2, 3] = RED
    out, n = k.smooth_jaggies(img, full(img), None)
    assert n == 1 and tuple(out[2, 3]) == BLUE
    line = image(5, 6, BLUE)
    line[3:, :] = RED
    line[1:3, 2] = RED
    assert k.smooth_jaggies(line, full(line), None)[1] == 0


def test_refinement_moves_a_bad_palette():
    reference = image(10, 1, (250, 250, 250, 255))
    reference[0, 6:, :3] = 230
    start = k.packed(np.array([[128, 128, 128]]))
    _, palette = k.refine(k.remap(reference, full(reference), start), reference, full(reference), None, start, 4)
    assert k.unpacked(palette)[:, 0].min() > 200


@pytest.mark.parametrize(("rule", "n"), [("pixel-art", 4), ("none", 8)])
def test_outline_of_one_pixel(rule, n):
    mask = np.zeros((5, 5), bool)
    mask[2, 2] = True
    ring = k.outline(mask, 1, 8, rule)
    assert ring.sum() == n and not (ring & mask).any()


def test_internal_outline_is_on_the_darker_side():
    img = image(4, 1, (20, 20, 20, 255))
    img[0, 2:, :3] = 240
    edges = k.internal_outline(img, full(img), 0.1)
    assert edges.tolist() == [[False, True, False, False]]
    assert not k.internal_outline(img, full(img), 0.0).any()
    assert not k.internal_outline(img, np.array([[1, 1, 0, 1]], bool), 0.1)[0, 2:].any()


def test_round_trip_through_oklab():
    rgb = np.array([[0, 0, 0], [255, 255, 255], [200, 30, 60], [12, 200, 90]], np.uint8)
    assert np.abs(k.from_oklab(k.oklab(rgb)).astype(int) - rgb).max() <= 1


def naive(values, radius, pick):
    h, w = values.shape
    return np.array([[pick(np.sort(values[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1].ravel())) for x in range(w)] for y in range(h)])


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 13), st.integers(1, 9), st.integers(1, 4), st.integers(0, 10**6))
def test_windows_equal_naive_ones(w, h, radius, seed):
    values = np.random.default_rng(seed).random((h, w))
    assert np.array_equal(k.window_extremum(values, radius, False), naive(values, radius, lambda v: v[0]))
    assert np.array_equal(k.window_extremum(values, radius, True), naive(values, radius, lambda v: v[-1]))
    bins = k.half_up(values * 255)
    assert np.allclose(k.window_median(values, radius) * 255, naive(bins, radius, lambda v: v[len(v) // 2]))


def test_a_skin_square_is_a_face():
    img = image(16, 16, (250, 250, 250, 255))
    img[4:12, 4:12, :3] = (222, 170, 130)
    img[6:8, 6:8, :3] = 10
    found = k.find_features(img)
    assert ("face", 4, 4, 12, 12, 0.6) in found and ("eye", 6, 6, 8, 8, 0.5) in found


def test_grid_boxes_cover_every_pixel_once():
    seen = np.zeros((5, 7), int)
    order = []
    for r, c, x0, y0, x1, y1 in sheets.Grid(2, 3).boxes(7, 5):
        seen[y0:y1, x0:x1] += 1
        order.append((r, c))
    assert (seen == 1).all() and order == sorted(order)
    assert sheets.CellSize(4, 3).boxes(7, 5)[-1] == (1, 1, 4, 3, 7, 5)


@pytest.mark.parametrize("spec", [sheets.Grid(0, 1), sheets.Grid(1, 2**32 - 1), sheets.CellSize(0, 1)])
def test_bad_specs(spec):
    with pytest.raises(ValueError):
        spec.check(7, 5)


def test_gutters_make_a_grid():
    sheet = image(38, 24)
    for y in (0, 14):
        for x in (0, 14, 28):
            sheet[y : y + 10, x : x + 10] = RED
    assert grid_of(sheet) == sheets.Grid(2, 3)
    single = image(24, 24)
    single[2:22, 2:22] = RED
    assert grid_of(single) is None


def test_conversion_of_a_square():
    img = image(24, 24)
    img[4:20, 4:20] = RED
    out = convert_image(img, preset(48))
    assert out.final.shape == (48, 48, 4) and out.alpha_binary and len(np.unique(k.packed(out.body[out.body_mask]))) <= 12
    assert out.body_pixels_in_reserved_border == 0 and not out.body_mask[:2].any()
    assert np.array_equal(out.final, convert_image(img, preset(48)).final)


def test_shared_palette_is_kept():
    frames = [image(24, 24) for _ in range(2)]
    rng = np.random.default_rng(1)
    for f in frames:
        f[4:20, 4:20, :3] = rng.integers(0, 255, (16, 16, 3))
        f[4:20, 4:20, 3] = 255
    palette = k.packed(np.array([[10, 10, 10], [100, 30, 30], [240, 240, 240]]))
    for f in frames:
        out = convert_image(f, preset(32), shared_palette=palette)
        assert np.array_equal(out.palette, palette) and np.isin(k.packed(out.body[out.body_mask]), palette).all()


def test_an_image_without_pixels_is_refused():
    with pytest.raises(ValueError):
        k.foreground(np.zeros((0, 3, 4), np.uint8), 96, 24)
