"""NumPy kernels on one image: for what is inherently sequential or iterative within an image.

Images are arrays of shape (height, width, 4), 8 bits a channel; masks are boolean arrays. The
relational operators of this package and these kernels are held against each other in the tests.
"""

from __future__ import annotations

import numpy as np

from rasterel.functions.color import FROM_LAB, FROM_LMS, TO_LAB, TO_LMS

_C = np.arange(256) / 255
LINEAR = np.where(_C <= 0.04045, _C / 12.92, ((_C + 0.055) / 1.055) ** 2.4)
EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounds halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def oklab(rgb: np.ndarray) -> np.ndarray:
    """Oklab of 8-bit colours, last axis 3."""
    return np.cbrt(LINEAR[rgb[..., :3]] @ np.array(TO_LMS).T) @ np.array(TO_LAB).T


def to_srgb(light: np.ndarray) -> np.ndarray:
    x = np.clip(light, 0, 1)
    s = np.where(x <= 0.0031308, x * 12.92, 1.055 * x ** (1 / 2.4) - 0.055)
    return np.clip(half_up(s * 255), 0, 255).astype(np.uint8)


def from_oklab(lab: np.ndarray) -> np.ndarray:
    return to_srgb(np.clip((lab @ np.array(FROM_LAB).T) ** 3 @ np.array(FROM_LMS).T, 0, 1))


def packed(rgb: np.ndarray) -> np.ndarray:
    c = rgb.astype(np.int64)
    return c[..., 0] << 16 | c[..., 1] << 8 | c[..., 2]


def unpacked(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes >> 16 & 255, codes >> 8 & 255, codes & 255], axis=-1).astype(np.uint8)


def shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """The array whose cell (y, x) is a's cell (y + dy, x + dx), or fill beyond the edge."""
    out = np.full_like(a, fill)
    h, w = a.shape[:2]
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


# Many images at once -----------------------------------------------------------------------------

#: Pixels of a canvas, and of a block of cells; a larger image or cell is one as a whole.
CANVAS, BLOCK = 1 << 18, 1 << 17


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(start, values) of an Arrow list column without nulls: row k has the values start[k] to start[k + 1]."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of y << 32 plus x."""
    x = ((at + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)
    return x, (at - x) >> 32


def canvases(x: np.ndarray, y: np.ndarray, start: np.ndarray, most: int = CANVAS):
    """(points, row, column, shape) of canvases: images one below the other, an empty row between.

    Image k has the points start[k] to start[k + 1], one at least. ``points`` is a slice, and ``row`` and ``column``
    are those points' places, so that what looks at neighbours can't tell a canvas from single images.
    """
    if len(start) < 2:
        return
    x0, y0 = np.minimum.reduceat(x, start[:-1]), np.minimum.reduceat(y, start[:-1])
    w, h = np.maximum.reduceat(x, start[:-1]) - x0 + 1, np.maximum.reduceat(y, start[:-1]) - y0 + 2
    widths, heights, first = w.tolist(), h.tolist(), 0
    while first < len(w):
        last, rows, width = first + 1, heights[first], widths[first]
        while last < len(w) and (rows + heights[last]) * max(width, widths[last]) <= most:
            rows, width, last = rows + heights[last], max(width, widths[last]), last + 1
        own, n = slice(first, last), np.diff(start[first : last + 1])
        p = slice(int(start[first]), int(start[last]))
        yield p, y[p] - np.repeat(y0[own] - (np.cumsum(h[own]) - h[own]), n), x[p] - np.repeat(x0[own], n), (rows, width)
        first = last


def blocks(start: np.ndarray, most: int = BLOCK):
    """(first, last) of runs of lists that hold so many values, one list at least."""
    first = 0
    while first < len(start) - 1:
        last = max(first + 1, int(np.searchsorted(start, start[first] + most, "right")) - 1)
        yield first, last
        first = last


# Masks ---------------------------------------------------------------------------------------


def transparent_share(image: np.ndarray) -> float:
    """The share of pixels that aren't fully opaque."""
    return float((image[..., 3] < 255).mean()) if image.size else 0.0


def foreground(image: np.ndarray, threshold: int, tolerance: int) -> tuple[np.ndarray, str]:
    """The foreground mask and where it comes from: alpha, or the colour of the corners."""
    if image.shape[0] == 0 or image.shape[1] == 0:
        raise ValueError("an image without pixels has no foreground")
    if transparent_share(image) > 0.01:
        return image[..., 3] >= threshold, "alpha"
    corners = image[[0, 0, -1, -1], [0, -1, 0, -1], :3].astype(int)
    ground = np.sort(corners, axis=0)[2]
    return np.abs(image[..., :3].astype(int) - ground).sum(axis=-1) > 3 * tolerance, "corner-background"


def label(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """For each set pixel the smallest row-major index of its component, -1 elsewhere."""
    h, w = mask.shape
    index = np.arange(h * w).reshape(h, w)
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * (connectivity == 8)
    ends = []
    for dy, dx in steps:
        both = mask & shifted(mask, dy, dx, False)
        ends.append((index[both], index[both] + dy * w + dx))
    up = np.arange(h * w)
    a, b = (np.concatenate(x) for x in zip(*ends))
    while len(a):
        ra, rb = up[a], up[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(nxt := up[up], up):
            up = nxt
    return np.where(mask, up.reshape(h, w), -1)


def components(mask: np.ndarray, connectivity: int = 8) -> list[tuple[int, int, int, int, int]]:
    """(size, x0, y0, x1, y1) of each component in scan order; upper bounds are exclusive."""
    labels = label(mask, connectivity)
    y, x = np.nonzero(mask)
    roots, which, size = np.unique(labels[y, x], return_inverse=True, return_counts=True)
    low, high = np.full((len(roots), 2), 1 << 40), np.full((len(roots), 2), -1)
    np.minimum.at(low, which, np.c_[x, y])
    np.maximum.at(high, which, np.c_[x, y])
    return [(int(n), int(a), int(b), int(c) + 1, int(d) + 1) for n, (a, b), (c, d) in zip(size, low, high)]


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    """The mask without 8-connected components below a size."""
    if least <= 1 or not mask.any():
        return mask.copy()
    labels = label(mask)
    size = np.bincount(labels[mask], minlength=mask.size)
    return mask & (size[np.maximum(labels, 0)] >= least)


def bounding_box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    y, x = np.nonzero(mask)
    return (int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1) if len(x) else None


# Windows and detail --------------------------------------------------------------------------


def window_extremum(values: np.ndarray, radius: int, largest: bool) -> np.ndarray:
    """Minimum or maximum over the square window, clamped at the edges; rows, then columns."""
    op, fill = (np.maximum, -np.inf) if largest else (np.minimum, np.inf)
    for axis in (1, 0):
        width, out, done = values.shape[axis], values, 0
        span = min(radius, width - 1)
        while done < span:  # doubling: a window of d each way and one of s more give d + s
            s = min(max(1, done), span - done)
            move = (lambda k: (0, k)) if axis else (lambda k: (k, 0))
            out = op(op(shifted(out, *move(-s), fill), shifted(out, *move(s), fill)), out)
            done += s
        values = out
    return values


def window_median(values: np.ndarray, radius: int) -> np.ndarray:
    """The upper median over the clamped square window of values in 256 bins, as bin / 255."""
    bins = half_up(np.clip(values, 0, 1) * 255)
    h, w = bins.shape
    size = 2 * radius + 1
    out = np.empty((h, w))
    padded = np.pad(bins, radius, constant_values=np.inf)
    xs = np.minimum(np.arange(w) + radius, w - 1) - np.maximum(np.arange(w) - radius, 0) + 1
    step = max(1, (1 << 22) // max(1, w * size * size))
    for y in range(0, h, step):  # rows at a time: memory doesn't grow with the image
        view = np.lib.stride_tricks.sliding_window_view(padded[y : min(h, y + step) + 2 * radius], (size, size))
        rows = np.arange(y, min(h, y + step))
        count = (np.minimum(rows + radius, h - 1) - np.maximum(rows - radius, 0) + 1)[:, None] * xs
        order = np.sort(view.reshape(*view.shape[:2], -1), axis=-1)
        out[rows] = np.take_along_axis(order, (count // 2)[..., None], axis=-1)[..., 0]
    return out / 255


def preserve_details(image: np.ndarray, mask: np.ndarray, radius: int, iterations: int) -> np.ndarray:
    """Foreground lightness moved between local extremes, toward bright detail where it stands out."""
    if radius == 0:
        return image
    lab = oklab(image)
    light = lab[..., 0]
    low, high, mid = window_extremum(light, radius, False), window_extremum(light, radius, True), window_median(light, radius)
    spread = np.maximum(high - mid, 0) - np.maximum(mid - low, 0)
    weight = 1 / (1 + np.exp(-4 * ((1 - mid) + spread)))
    for _ in range(max(1, iterations) - 1):
        low, high = window_extremum(low, radius, False), window_extremum(high, radius, True)
    lab[..., 0] = np.clip(low + (high - low) * weight, 0, 1)
    out = image.copy()
    out[mask, :3] = from_oklab(lab[mask])
    return out


def posterize(image: np.ndarray, mask: np.ndarray, levels: int) -> np.ndarray:
    if levels < 2:
        return image
    lab = oklab(image[mask])
    lab[:, 0] = half_up(lab[:, 0] * (levels - 1)) / (levels - 1)
    out = image.copy()
    out[mask, :3] = from_oklab(lab)
    return out


def flat_bands(image: np.ndarray, mask: np.ndarray, levels: int) -> np.ndarray:
    """Posterized lightness, and in each band the band's mean hue."""
    if levels < 2:
        return image
    out = posterize(image, mask, levels)
    lab = oklab(out[mask])
    band = np.clip(half_up(lab[:, 0] * (levels - 1)), 0, levels - 1).astype(int)
    n = np.maximum(np.bincount(band, minlength=levels), 1)
    for c in (1, 2):
        lab[:, c] = (np.bincount(band, lab[:, c], levels) / n)[band]
    out[mask, :3] = from_oklab(lab)
    return out


# Features ------------------------------------------------------------------------------------

CRITICAL = ("face", "eye", "sunglasses")


def find_features(image: np.ndarray) -> list[tuple[str, int, int, int, int, float]]:
    """(kind, x0, y0, x1, y1, confidence): the largest plausible patch of skin and dark blobs in it."""
    h, w = image.shape[:2]
    lab, solid = oklab(image), image[..., 3] >= 96
    light, a, b = lab[..., 0], lab[..., 1], lab[..., 2]
    skin = solid & (light > 0.5) & (light < 0.92) & (a > 0.035) & (b > 0.05) & (b < 0.2)
    patches = sorted(components(skin, 4), key=lambda c: -c[0])
    face = next((c[1:] for c in patches if (c[3] - c[1]) * (c[4] - c[2]) <= w * h // 3), None)
    if face is None:
        return []
    x0, y0, x1, y1 = face
    dark = np.zeros((h, w), bool)
    dark[y0:y1, x0:x1] = (solid & (light < 0.45))[y0:y1, x0:x1]
    eyes = [c[1:] for c in components(dark, 4) if c[0] >= 2 and c[3] - c[1] <= (x1 - x0) // 2]
    return [("face", *face, 0.6), *(("eye", *e, 0.5) for e in eyes)]


def feature_maps(shape: tuple[int, int], regions: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(critical mask, highest confidence of any region) for each pixel."""
    critical, weight = np.zeros(shape, bool), np.zeros(shape)
    for kind, x0, y0, x1, y1, confidence in regions:
        weight[y0:y1, x0:x1] = np.maximum(weight[y0:y1, x0:x1], confidence)
        critical[y0:y1, x0:x1] |= kind in CRITICAL
    return critical, weight


# Sampling ------------------------------------------------------------------------------------


def bounds(length: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """[begin, end) of each of ``parts`` cells over ``length`` pixels, at least a pixel each."""
    begin = np.arange(parts) * length // parts
    return begin, np.maximum((np.arange(parts) + 1) * length // parts, begin + 1)


def kcentroid(lab: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The centre of the heaviest of k clusters after eight rounds from even quantiles."""
    k = min(k, len(lab))
    order = np.lexsort((lab[:, 2], lab[:, 1], lab[:, 0]))
    at = [len(order) // 2] if k == 1 else [j * (len(order) - 1) // (k - 1) for j in range(k)]
    centres = lab[order[at]].copy()
    for _ in range(8):
        own = ((lab[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        total = np.bincount(own, weight, k)
        for c in range(3):
            centres[:, c] = np.where(total > 0, np.bincount(own, weight * lab[:, c], k) / np.where(total > 0, total, 1), centres[:, c])
    return centres[np.bincount(own, weight, k).argmax()]


def kcentroids(lab: np.ndarray, weight: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """``kcentroid`` of many cells: cell c has the colours start[c] to start[c + 1], one at least."""
    n, first = np.diff(start), start[:-1]
    k = max(1, min(k, int(n.max())))
    cell = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((lab[:, 2], lab[:, 1], lab[:, 0], cell))
    own_k, j = np.minimum(n, k)[:, None], np.arange(k)[None]
    at = np.where(own_k == 1, n[:, None] // 2, np.minimum(j, own_k - 1) * (n[:, None] - 1) // np.maximum(own_k - 1, 1))
    centres, none = lab[order[first[:, None] + at]], j >= own_k
    for _ in range(8):
        far = ((lab[:, None] - centres[cell]) ** 2).sum(axis=2)
        own = cell * k + np.where(none[cell], np.inf, far).argmin(axis=1)
        total = np.bincount(own, weight, len(n) * k).reshape(-1, k)
        some, before = np.where(total > 0, total, 1), centres.copy()
        for c in range(3):
            centres[..., c] = np.where(total > 0, np.bincount(own, weight * lab[:, c], len(n) * k).reshape(-1, k) / some, centres[..., c])
        if np.array_equal(before, centres):
            break
    return centres[np.arange(len(n)), np.where(none, -1, total).argmax(axis=1)]


def sample(image: np.ndarray, mask: np.ndarray, box: tuple[int, int, int, int], size: tuple[int, int], mode: str, centroids: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells of shape (height, width, 4), coverage): the box reduced to size (width, height).

    weight: alpha times saliency of each pixel. Area: the mean in linear light. Mode: the heaviest
    exact colour, the lowest of equals. K-centroid: the centre of the heaviest cluster.
    """
    x0, y0, x1, y1 = box
    (bx, ex), (by, ey) = bounds(max(1, x1 - x0), size[0]), bounds(max(1, y1 - y0), size[1])
    # Every (cell, pixel) pair; cells overlap when the target is larger than the box.
    px, cx = np.concatenate([np.arange(a, b) for a, b in zip(bx, ex)]) + x0, np.repeat(np.arange(size[0]), ex - bx)
    py, cy = np.concatenate([np.arange(a, b) for a, b in zip(by, ey)]) + y0, np.repeat(np.arange(size[1]), ey - by)
    cell = (cy[:, None] * size[0] + cx).ravel()
    inside = mask[py[:, None], px].ravel()
    n = size[0] * size[1]
    coverage = np.bincount(cell, inside, n) / np.bincount(cell, minlength=n)
    colour, w = image[py[:, None], px, :3].reshape(-1, 3)[inside], weight[py[:, None], px].ravel()[inside]
    cell = cell[inside]
    colour, cell, w = colour[w > 0], cell[w > 0], w[w > 0]
    out = np.zeros((n, 4), np.uint8)
    total = np.bincount(cell, w, n)
    some = total > 0
    out[some, 3] = 255
    if mode == "area":
        for c in range(3):
            out[some, c] = to_srgb(np.bincount(cell, w * LINEAR[colour[:, c]], n)[some] / total[some])
    elif mode == "mode":
        keys, which = np.unique(cell << 24 | packed(colour), return_inverse=True)
        votes = np.bincount(which, w)
        order = np.lexsort((keys, -votes, keys >> 24))
        first = order[np.unique(keys[order] >> 24, return_index=True)[1]]
        out[keys[first] >> 24, :3] = unpacked(keys[first] & 0xFFFFFF)
    else:
        lab, order = oklab(colour), np.argsort(cell, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
            out[cell[part[0]], :3] = from_oklab(kcentroid(lab[part], w[part], centroids))
    return out.reshape(size[1], size[0], 4), coverage.reshape(size[1], size[0])


# Palettes ------------------------------------------------------------------------------------


def histogram(codes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, weights, counts) of the distinct (code, weight) pairs."""
    if not len(codes):
        return codes, weight, np.empty(0, np.int64)
    order = np.lexsort((weight, codes))
    codes, weight = codes[order], weight[order]
    new = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (weight[1:] != weight[:-1])])
    return codes[new], weight[new], np.diff(np.r_[new, len(codes)])


def median_cut(codes: np.ndarray, weight: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Codes of at most ``most`` mean colours of boxes cut at weighted medians of their widest channel.

    Rows stand for count pixels of one colour and weight each. A cut is between pixels, so it may
    divide a row. Pixels equal in the channel are in order of colour and weight.
    """
    if not len(codes):
        return codes
    boxes = [(oklab(unpacked(codes)), codes, weight, count)]
    while len(boxes) < most:
        spans = [np.ptp(b[0], axis=0) if b[3].sum() > 1 else np.zeros(3) for b in boxes]
        widest = [s.max() for s in spans]
        pick = int(np.argmax(widest))
        if widest[pick] <= 0:
            break
        lab, own, w, n = boxes[pick]
        channel = int(spans[pick].argmax())
        order = np.lexsort((w, own, lab[:, channel]))
        lab, own, w, n = lab[order], own[order], w[order], n[order]
        half = (w * n).sum() / 2
        before = np.cumsum(w * n) - w * n
        row = min(int(np.searchsorted(before + w * n, half)), len(w) - 1)
        into = int(np.clip(np.ceil((half - before[row]) / w[row]), 1, n[row])) if w[row] > 0 else 1
        cut = int(np.clip(n[:row].sum() + into, 1, n.sum() - 1))
        left = np.clip(cut - (np.cumsum(n) - n), 0, n)
        halves = [(lab[k > 0], own[k > 0], w[k > 0], k[k > 0]) for k in (left, n - left)]
        boxes[pick] = boxes[-1]  # the last box moves into the gap
        boxes[-1:] = halves
    means = [np.average(lab, axis=0, weights=w * n if (w * n).sum() > 0 else n) for lab, _, w, n in boxes]
    return np.unique(packed(from_oklab(np.array(means))))


def shares(budget: int) -> tuple[int, int]:
    """Colours for critical pixels and for the others."""
    own = min(max(budget // 3, 1), max(budget - 1, 1))
    return own, max(budget - own, 1)


def palette_of(critical: tuple, others: tuple, budget: int) -> np.ndarray:
    """The palette for two histograms: all colours if they fit, else cuts of both."""
    budget = max(budget, 1)
    distinct = np.unique(np.concatenate([critical[0], others[0]]))
    if len(distinct) <= budget:
        return distinct
    if not len(critical[0]):
        return median_cut(*others, budget)
    own, rest = shares(budget)
    return np.unique(np.concatenate([median_cut(*critical, own), median_cut(*others, rest)]))


def nearest(lab: np.ndarray, palette_lab: np.ndarray) -> np.ndarray:
    """The index of the nearest palette colour, the lowest of equals."""
    out = np.empty(len(lab), np.int64)
    for i in range(0, len(lab), 1 << 16):
        out[i : i + (1 << 16)] = ((lab[i : i + (1 << 16), None] - palette_lab[None]) ** 2).sum(axis=2).argmin(axis=1)
    return out


def remap(image: np.ndarray, mask: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Masked pixels become their nearest palette colours, opaque. Distances are taken once a colour."""
    if not len(palette):
        return image
    codes, which = np.unique(packed(image[mask]), return_inverse=True)
    colours = unpacked(palette)
    out = image.copy()
    out[mask] = np.c_[colours[nearest(oklab(unpacked(codes)), oklab(colours))], np.full(len(codes), 255, np.uint8)][which]
    return out


def quantize(body: np.ndarray, mask: np.ndarray, lock: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(remapped body, palette); locked pixels get colours of their own."""
    codes = packed(body)
    groups = [mask] if lock is None or not lock.any() else [mask & lock, mask & ~lock]
    budgets = [max(budget, 1)] if len(groups) == 1 else shares(max(budget, 1))
    parts = [median_cut(*histogram(codes[g], np.ones(g.sum())), n) for g, n in zip(groups, budgets) if g.any()]
    palette = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
    return remap(body, mask, palette), palette


def refine(body: np.ndarray, reference: np.ndarray, mask: np.ndarray, lock: np.ndarray | None, palette: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd rounds over the colours from before quantization; colours of locked pixels stay."""
    if not len(palette) or rounds == 0:
        return body, palette
    free = mask if lock is None else mask & ~lock
    held = np.zeros(len(palette), bool) if lock is None else np.isin(palette, packed(body)[mask & lock])
    codes, counts = np.unique(packed(reference[free]), return_counts=True)
    lab, centres = oklab(unpacked(codes)), oklab(unpacked(palette))
    for _ in range(rounds):
        own = nearest(lab, centres)
        n = np.bincount(own, counts, len(centres))
        moved = np.stack([np.bincount(own, counts * lab[:, c], len(centres)) for c in range(3)], axis=1)
        move = (n > 0) & ~held
        centres[move] = moved[move] / n[move, None]
    palette = np.unique(packed(from_oklab(centres)))
    out = body.copy()
    out[free] = remap(reference, free, palette)[free]
    return out, palette


# Clean-up ------------------------------------------------------------------------------------


def _codes(body: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Colours with alpha as numbers that sort as (r, g, b, a) does; -1 outside the mask."""
    return np.where(mask, packed(body) << 8 | body[..., 3].astype(np.int64), -1)


def _most_frequent(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) along the first axis, the lowest of equals; codes below 0 don't count."""
    around = np.sort(around, axis=0)
    count = (around[:, None] == around[None]).sum(axis=1) * (around >= 0)
    at = count.argmax(axis=0)[None]
    return np.take_along_axis(around, at, 0)[0], np.take_along_axis(count, at, 0)[0]


def _recoloured(body: np.ndarray, where: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = body.copy()
    out[where, :3] = unpacked(codes[where] >> 8)
    out[where, 3] = codes[where] & 255
    return out


def merge_orphans(body: np.ndarray, mask: np.ndarray, lock: np.ndarray | None) -> tuple[np.ndarray, int]:
    """Pixels without an equal neighbour take the most frequent colour around."""
    own = _codes(body, mask)
    around = np.stack([shifted(own, dy, dx, -1) for dy, dx in EIGHT])
    lone = mask & (around >= 0).any(axis=0) & ~(around == own).any(axis=0)
    if lock is not None:
        lone &= ~lock
    code = np.zeros_like(own)
    code[lone] = _most_frequent(around[:, lone])[0]  # votes are counted where they matter
    return _recoloured(body, lone, code), int(lone.sum())


def smooth_jaggies(body: np.ndarray, mask: np.ndarray, lock: np.ndarray | None) -> tuple[np.ndarray, int]:
    """Single pixels that stick out of a flat edge join the colour on the other three sides."""
    own = _codes(body, mask)
    same = {d: (shifted(own, *d, -1) == own) & mask for d in EIGHT}
    one = sum(same[d].astype(int) for d in FOUR) == 1
    flat = np.zeros(mask.shape, bool)
    for dy, dx in FOUR:
        sides = [(dy + dx * s, dx + dy * s) for s in (1, -1)]
        flat |= same[dy, dx] & same[sides[0]] & same[sides[1]]
    around = np.stack([shifted(own, *d, -1) for d in FOUR])
    out = mask & one & flat
    code, few = np.zeros_like(own), around[:, out]
    code[out], count = _most_frequent(np.where(few == own[out], -1, few))
    out[out] = count >= 3
    if lock is not None:
        out &= ~lock
    return _recoloured(body, out, code), int(out.sum())


def converge(body: np.ndarray, mask: np.ndarray, lock: np.ndarray | None, orphans: bool, jaggies: bool) -> np.ndarray:
    """Up to four rounds of the clean-up rules, until nothing changes."""
    for _ in range(4):
        changed = 0
        for wanted, rule in ((orphans, merge_orphans), (jaggies, smooth_jaggies)):
            if wanted:
                body, n = rule(body, mask, lock)
                changed += n
        if not changed:
            break
    return body


# Outlines ------------------------------------------------------------------------------------


def dilate(mask: np.ndarray, width: int, connectivity: int) -> np.ndarray:
    for _ in range(width):
        mask = np.logical_or.reduce([mask, *(shifted(mask, dy, dx, False) for dy, dx in (FOUR if connectivity == 4 else EIGHT))])
    return mask


def outline(mask: np.ndarray, width: int, connectivity: int, corner_rule: str) -> np.ndarray:
    """The ring around a mask; the corner rule drops pixels that touch it at one corner only."""
    ring = dilate(mask, max(width, 1), connectivity) & ~mask
    if corner_rule == "pixel-art" and connectivity == 8:
        sides = np.logical_or.reduce([shifted(mask, *d, False) for d in FOUR])
        corners = sum(shifted(mask, *d, False).astype(int) for d in EIGHT if d not in FOUR)
        ring &= sides | (corners != 1)
    return ring


def internal_outline(body: np.ndarray, mask: np.ndarray, threshold: float) -> np.ndarray:
    """The darker pixel on each edge between neighbours that differ by more than the threshold."""
    edges = np.zeros(mask.shape, bool)
    if threshold <= 0:
        return edges
    lab = oklab(body)
    for dy, dx in ((0, 1), (1, 0)):
        there = shifted(lab, dy, dx, 0.0)
        border = mask & shifted(mask, dy, dx, False) & (((lab - there) ** 2).sum(axis=-1) > threshold**2)
        here = lab[..., 0] <= there[..., 0]
        edges |= border & here
        edges |= shifted(border & ~here, -dy, -dx, False)
    return edges
