"""Small numpy functions on one picture, called inside tasks on Arrow batches."""

from __future__ import annotations

import zlib

import numpy as np

# Published defaults of the sample-based background model.
N_SAMPLES, RADIUS, MIN_MATCHES, UPDATE_FACTOR = 20, 20, 2, 16
# Place of the last sample that all pixels are held against.
FIRST_SAMPLES = 2
# Fixed value: grey-level change between two frames that counts as a difference.
DIFF_THRESHOLD = 20


def merge_rects(rects: list[list[int]]) -> list[list[int]]:
    """Merge corner boxes given from left to right; touching counts, and earlier boxes are not looked at again."""
    pending = list(rects)
    done = []
    while pending:
        x1, y1, x2, y2 = pending.pop(0)
        hit = True
        while hit:
            hit = False
            for at, (a1, b1, a2, b2) in enumerate(pending):
                if a1 <= x2 and b1 <= y2 and b2 >= y1:
                    x1, y1, x2, y2 = min(x1, a1), min(y1, b1), max(x2, a2), max(y2, b2)
                    del pending[at]
                    hit = True
                    break
        done.append([x1, y1, x2, y2])
    return done


def rescale(img: np.ndarray, width: int, height: int, method: str = "linear") -> np.ndarray:
    """Resize a grey picture, by bilinear interpolation at pixel centres or by taking the nearest point."""
    h, w = img.shape
    if (w, h) == (width, height):
        return img
    if method == "point":
        rows = (2 * np.arange(height) + 1) * h // (2 * height)
        cols = (2 * np.arange(width) + 1) * w // (2 * width)
        return img[rows[:, None], cols]

    def weights(n_out: int, n_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0, n_in - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n_in - 1), at - low

    top, bottom, fy = weights(height, h)
    left, right, fx = weights(width, w)
    src = img.astype(np.float64)
    across = src[:, left] * (1 - fx) + src[:, right] * fx
    out = across[top] * (1 - fy[:, None]) + across[bottom] * fy[:, None]
    return np.floor(out + 0.5).astype(np.uint8)


def crop(img: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The rectangle of a picture, or all of it when the rectangle does not lie inside."""
    rows, cols = img.shape
    if x < 0 or y < 0 or w < 0 or h < 0 or x + w > cols or y + h > rows:
        return img
    return img[y : y + h, x : x + w]


def picture_rng(token: str, zone: int, frame_no: int) -> np.random.Generator:
    """Random numbers fixed by camera, zone and frame, so that a repeated task gives the same result."""
    return np.random.default_rng([zlib.crc32(token.encode()), zone & 0xFFFFFFFF, int(frame_no) & 0xFFFFFFFF])


def _beside(y: np.ndarray, x: np.ndarray, shape: tuple[int, int], rng: np.random.Generator) -> tuple:
    """For each place itself or one of its eight neighbours, by chance, held inside the picture."""
    step = rng.integers(-1, 2, (2, *y.shape), dtype=np.int8)
    return np.clip(y + step[0], 0, shape[0] - 1), np.clip(x + step[1], 0, shape[1] - 1)


def init_model(img: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Past samples of each pixel, drawn from the pixel and its neighbours in the first frame."""
    y, x = np.indices(img.shape, dtype=np.int32)
    return np.stack([img[_beside(y, x, img.shape, rng)] for _ in range(N_SAMPLES)])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Absolute differences of bytes, without wider numbers."""
    return np.maximum(a, b) - np.minimum(a, b)


def foreground(model: np.ndarray, img: np.ndarray) -> np.ndarray:
    """True where fewer than two past samples lie within the radius of the pixel.

    Most pixels find theirs among the first samples; only those that do not are held against the others, unless they are many.
    """
    near = np.zeros(img.shape, dtype=np.uint8)
    for at, sample in enumerate(model):
        near += _apart(sample, img) <= RADIUS
        if at == FIRST_SAMPLES:
            short = np.flatnonzero(near < MIN_MATCHES)
            if 8 * len(short) < img.size:
                rest = np.take(model[at + 1 :].reshape(-1, img.size), short, axis=1)
                found = (_apart(rest, img.reshape(-1)[short]) <= RADIUS).sum(axis=0, dtype=np.uint8)
                near.reshape(-1)[short] += found
                break
    return near < MIN_MATCHES


def _chosen(fg: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Places of background pixels, picked with probability one over the update factor: one random byte for each pixel."""
    lots = rng.integers(0, 1 << 32, -(-fg.size // 4), dtype=np.uint32).astype("<u4", copy=False).view(np.uint8)[: fg.size]
    return np.flatnonzero((lots < 256 // UPDATE_FACTOR) & ~fg.reshape(-1))


def update_model(model: np.ndarray, img: np.ndarray, fg: np.ndarray, rng: np.random.Generator) -> None:
    """Put some background pixels into the samples of themselves and of a neighbour, in place."""
    samples, flat = model.reshape(-1), img.reshape(-1)
    at = _chosen(fg, rng)
    samples[rng.integers(0, N_SAMPLES, len(at)) * img.size + at] = flat[at]
    at = _chosen(fg, rng)
    depth = rng.integers(0, N_SAMPLES, len(at))
    y, x = _beside(*np.divmod(at, img.shape[1]), img.shape, rng)
    samples[depth * img.size + y * img.shape[1] + x] = flat[at]


def dilate(mask: np.ndarray) -> np.ndarray:
    """Spread a mask by one pixel in all eight directions."""
    wide = mask.copy()
    wide[:, 1:] |= mask[:, :-1]
    wide[:, :-1] |= mask[:, 1:]
    out = wide.copy()
    out[1:] |= wide[:-1]
    out[:-1] |= wide[1:]
    return out


def _runs(mask: np.ndarray, reach: int) -> np.ndarray:
    """The horizontal runs of a mask as rows (y, from, to, number), connected parts numbered from 1.

    ``reach`` 1 joins diagonal neighbours, 0 does not. Runs of neighbouring lines that touch get the lowest number
    among them until nothing changes.
    """
    h, w = mask.shape
    lines = np.zeros(h * (w + 1) + 1, dtype=bool)  # a gap before the first line and after each
    lines[1:].reshape(h, w + 1)[:, :w] = mask
    turns = np.flatnonzero(lines[1:] != lines[:-1])
    row, start = np.divmod(turns[::2], w + 1)
    end = turns[1::2] - row * (w + 1)
    n = len(row)
    if n == 0:
        return np.empty((0, 4), dtype=np.int64)
    pitch = w + 4
    first = np.searchsorted(row * pitch + end, (row + 1) * pitch + start - reach, side="right")
    last = np.searchsorted(row * pitch + start, (row + 1) * pitch + end + reach, side="left")
    many = np.maximum(last - first, 0)
    upper = np.repeat(np.arange(n), many)
    lower = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    parent = np.arange(n)
    while True:
        low = np.minimum(parent[upper], parent[lower])
        nxt = parent.copy()
        np.minimum.at(nxt, parent[upper], low)
        np.minimum.at(nxt, parent[lower], low)
        nxt = nxt[nxt]
        if np.array_equal(nxt, parent):
            break
        parent = nxt
    number = np.unique(parent, return_inverse=True)[1] + 1
    return np.stack([row, start, end, number], axis=1)


def _painted(out: np.ndarray, runs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Set the cells of each run to its value, in place."""
    row, start, end = runs[:, 0], runs[:, 1], runs[:, 2]
    length = end - start
    cells = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out.reshape(-1)[cells + np.repeat(row * out.shape[1] + start, length)] = np.repeat(values, length)
    return out


def contour_boxes(mask: np.ndarray, min_area: float, dx: int = 0, dy: int = 0) -> list[list[int]]:
    """Corner boxes of the outer contours whose polygon is at least ``min_area``.

    The polygon runs through pixel centres. Between four neighbouring centres it covers everything when all four
    belong to the filled part, half when three do, and nothing otherwise, so areas are sums over such squares.
    """
    lines, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(lines):
        return []
    top, left = lines[0], columns[0]
    mask = mask[top : lines[-1] + 1, left : columns[-1] + 1]
    # what the ring around the picture does not reach is filled; the ring is the first run
    around = _runs(~np.pad(mask, 1), reach=0)
    holes = around[around[:, 3] != around[0, 3]]
    some = _painted(mask.copy(), holes - [1, 1, 1, 0], np.ones(len(holes), dtype=bool))
    found = _runs(some, reach=1)
    n = found[:, 3].max()
    part = _painted(np.zeros(some.shape, dtype=np.int32), found, found[:, 3])
    cells = some.view(np.int8)
    held = cells[:-1, :-1] + cells[:-1, 1:] + cells[1:, :-1] + cells[1:, 1:]
    y, x = np.divmod(np.flatnonzero(held >= 3), max(held.shape[1], 1))
    # of three or four pixels at least one of a diagonal pair is set
    owner = np.maximum(part[y, x], part[y + 1, x + 1])
    area = np.bincount(owner, weights=np.where(held[y, x] == 4, 1.0, 0.5), minlength=n + 1)
    box = np.empty((4, n + 1), dtype=np.int64)
    box[:2], box[2:] = np.iinfo(np.int64).max, -1
    np.minimum.at(box[0], found[:, 3], found[:, 1])
    np.minimum.at(box[1], found[:, 3], found[:, 0])
    np.maximum.at(box[2], found[:, 3], found[:, 2])
    np.maximum.at(box[3], found[:, 3], found[:, 0] + 1)
    ox, oy = dx + int(left), dy + int(top)
    return [
        [int(box[0, k]) + ox, int(box[1, k]) + oy, int(box[2, k]) + ox, int(box[3, k]) + oy]
        for k in range(1, n + 1)
        if area[k] >= min_area
    ]


class ZoneDetector:
    """Background model and last picture of one camera zone, kept as one run of bytes between calls."""

    def __init__(self, blob: bytes | None = None):
        self.rect, self.model, self.last = None, None, None
        if blob:
            head = np.frombuffer(blob, dtype=np.int32, count=6)
            self.rect, (h, w) = tuple(int(v) for v in head[:4]), head[4:]
            body = np.frombuffer(blob, dtype=np.uint8, offset=24)
            self.model = body[: N_SAMPLES * h * w].reshape(N_SAMPLES, h, w).copy()
            self.last = body[N_SAMPLES * h * w :].reshape(h, w).copy()

    def dump(self) -> bytes:
        if self.model is None:
            return b""
        head = np.array([*self.rect, *self.last.shape], dtype=np.int32)
        return head.tobytes() + self.model.tobytes() + self.last.tobytes()

    def masks(self, roi: np.ndarray, rect: tuple, token: str, zone: int, frame_no: int) -> np.ndarray | None:
        """Changed foreground of a picture, or None when it starts the model anew."""
        rng = picture_rng(token, zone, frame_no)
        if self.model is None or self.rect != rect or self.last.shape != roi.shape:
            self.rect, self.model, self.last = rect, init_model(roi, rng), roi.copy()
            return None
        fg = foreground(self.model, roi)
        update_model(self.model, roi, fg, rng)
        moved = _apart(roi, self.last) > DIFF_THRESHOLD
        self.last = roi.copy()
        return dilate(fg & moved)


def block_sums(a: np.ndarray, b: np.ndarray, step: int = 4, size: int = 8, first_col: int = 8) -> np.ndarray:
    """Absolute differences summed over ``size`` squares placed every ``step`` pixels, from column ``first_col``."""
    d = np.abs(a.astype(np.int64) - b.astype(np.int64))
    total = np.pad(d, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    h, w = a.shape
    ys = np.arange(0, h - size + 1, step)[:, None]
    xs = np.arange(first_col, w - size + 1, step)[None, :]
    return total[ys + size, xs + size] - total[ys, xs + size] - total[ys + size, xs] + total[ys, xs]


def interlace_sums(prev: np.ndarray, cur: np.ndarray, nxt: np.ndarray) -> tuple[list[int], int, list[int]]:
    """Row comparisons of a picture with its neighbours in time: alpha and gamma per field, and delta."""
    p, c, n = (x.astype(np.int64) for x in (prev, cur, nxt))
    mid = slice(2, c.shape[0] - 2)
    ends = c[1:-3] + c[3:-1]

    def comb(row: np.ndarray) -> np.ndarray:
        return np.abs(ends - 2 * row).sum(axis=1)

    with_prev, with_next, with_self = comb(p[mid]), comb(n[mid]), comb(c[mid])
    still = np.abs(2 * c[mid] - 2 * p[mid]).sum(axis=1)
    odd = (np.arange(2, c.shape[0] - 2) & 1).astype(bool)
    alpha = [
        int(with_prev[~odd].sum() + with_next[odd].sum()),
        int(with_prev[odd].sum() + with_next[~odd].sum()),
    ]
    gamma = [int(still[odd].sum()), int(still[~odd].sum())]
    return alpha, int(with_self.sum()), gamma


def outlier_pixels(img: np.ndarray) -> int:
    """Pixels that stick out from the lines above and below, themselves and both side neighbours alike."""
    p = img.astype(np.int32)
    h, w = p.shape

    def sticks_out(j: int) -> np.ndarray:
        up, mid, down = p[: h - 2 * j], p[j : h - j], p[2 * j :]
        hit = (np.abs(up - mid) + np.abs(down - mid)) // 2 - np.abs(down - up) > 4
        three = hit[:, :-2] & hit[:, 1:-1] & hit[:, 2:]
        out = np.zeros((h, max(w - 2, 0)), dtype=bool)
        out[j : h - j] = three
        return out

    if h < 3 or w < 3:
        return 0
    near = sticks_out(1)
    if h >= 5:
        near[2 : h - 2] &= sticks_out(2)[2 : h - 2]
    return int(near.sum())


def repeated_line_pixels(img: np.ndarray) -> int:
    """Pixels of lines that differ from the line four above by less than one level per pixel."""
    p = img.astype(np.int64)
    diff = np.abs(p[4:] - p[:-4]).sum(axis=1)
    return int((diff < p.shape[1]).sum()) * p.shape[1]


def out_of_range_pixels(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> int:
    """Pixels whose luma or chroma leaves the legal range; a chroma sample counts for the pixels it covers."""
    sy, sx = y.shape[0] // u.shape[0], y.shape[1] // u.shape[1]
    bad_chroma = (u < 16) | (u > 240) | (v < 16) | (v > 240)
    spread = np.repeat(np.repeat(bad_chroma, sy, axis=0), sx, axis=1)
    return int(((y < 16) | (y > 235) | spread).sum())


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity over 8x8 windows placed every 4 pixels."""
    # The two stabilising terms for 8-bit pictures.
    c1, c2 = int(0.01 * 0.01 * 255 * 255 * 64 + 0.5), int(0.03 * 0.03 * 255 * 255 * 64 * 63 + 0.5)
    h, w = a.shape[0] // 4 * 4, a.shape[1] // 4 * 4
    x, y = a[:h, :w].astype(np.int64), b[:h, :w].astype(np.int64)

    def windows(v: np.ndarray) -> np.ndarray:
        q = v.reshape(h // 4, 4, w // 4, 4).sum(axis=(1, 3))
        return q[:-1, :-1] + q[:-1, 1:] + q[1:, :-1] + q[1:, 1:]

    s1, s2, ss, s12 = windows(x), windows(y), windows(x * x + y * y), windows(x * y)
    spread = ss * 64 - s1 * s1 - s2 * s2
    shared = s12 * 64 - s1 * s2
    value = (2.0 * s1 * s2 + c1) * (2.0 * shared + c2) / ((s1 * s1 + s2 * s2 + c1) * 1.0 * (spread + c2))
    return float(value.mean())
