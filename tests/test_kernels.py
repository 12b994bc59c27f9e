"""Picture kernels against slow plain loops."""

from collections import deque

import numpy as np
import pytest

from framewell.operators import kernels as K


def outer_boxes(mask, min_area):
    """Flood fill by hand: fill holes, take 8-connected parts, trace areas by unit squares."""
    h, w = mask.shape
    outside = np.zeros((h + 2, w + 2), dtype=bool)
    padded = np.pad(mask, 1)
    todo = deque([(0, 0)])
    outside[0, 0] = True
    while todo:
        y, x = todo.popleft()
        for b, a in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= b < h + 2 and 0 <= a < w + 2 and not outside[b, a] and not padded[b, a]:
                outside[b, a] = True
                todo.append((b, a))
    filled = ~outside[1:-1, 1:-1]
    seen, out = np.zeros_like(filled), []
    for y0 in range(h):
        for x0 in range(w):
            if not filled[y0, x0] or seen[y0, x0]:
                continue
            part = {(y0, x0)}
            todo = deque(part)
            seen[y0, x0] = True
            while todo:
                y, x = todo.popleft()
                for b in (y - 1, y, y + 1):
                    for a in (x - 1, x, x + 1):
                        if 0 <= b < h and 0 <= a < w and filled[b, a] and not seen[b, a]:
                            seen[b, a] = True
                            part.add((b, a))
                            todo.append((b, a))
            corners = {(y - j, x - i) for y, x in part for j in (0, 1) for i in (0, 1)}
            area = 0.0
            for y, x in corners:
                held = sum((y + j, x + i) in part for j in (0, 1) for i in (0, 1))
                area += {4: 1.0, 3: 0.5}.get(held, 0.0)
            if area >= min_area:
                ys, xs = [p[0] for p in part], [p[1] for p in part]
                out.append([min(xs), min(ys), max(xs) + 1, max(ys) + 1])
    return sorted(out)


@pytest.mark.parametrize("seed", range(20))
def test_contour_boxes_on_random_masks(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((rng.integers(1, 25), rng.integers(1, 25))) < rng.choice([0.1, 0.3, 0.5, 0.7])
    for area in (0, 0.5, 3):
        assert sorted(K.contour_boxes(mask, area)) == outer_boxes(mask, area)


def test_area_of_a_block_runs_through_pixel_centres():
    mask = np.zeros((20, 20), dtype=bool)
    mask[2:8, 3:13] = True
    assert K.contour_boxes(mask, 45) == [[3, 2, 13, 8]]
    assert K.contour_boxes(mask, 45.5) == []


def test_hole_and_island_inside_are_part_of_the_outer_contour():
    mask = np.zeros((12, 12), dtype=bool)
    mask[1:11, 1:11] = True
    mask[3:9, 3:9] = False
    mask[5:7, 5:7] = True
    assert K.contour_boxes(mask, 81) == [[1, 1, 11, 11]]


def test_merge_rects_keeps_order_and_does_not_look_back():
    # the second box grows over the first one only after the first was done
    boxes = [[0, 0, 2, 2], [3, 20, 4, 30], [4, 0, 30, 25]]
    assert K.merge_rects(boxes) == [[0, 0, 2, 2], [3, 0, 30, 30]]
    assert K.merge_rects([[0, 0, 2, 2], [2, 2, 3, 3]]) == [[0, 0, 3, 3]]
    assert K.merge_rects([[0, 0, 2, 2], [3, 0, 4, 2]]) == [[0, 0, 2, 2], [3, 0, 4, 2]]


def test_merge_rects_takes_a_box_passed_over_before():
    # the third box makes the first reach the second
    assert K.merge_rects([[0, 0, 2, 2], [1, 5, 2, 6], [2, 0, 4, 7]]) == [[0, 0, 4, 7]]


def test_dilate_spreads_one_pixel_and_stays_inside():
    mask = np.zeros((4, 5), dtype=bool)
    mask[0, 0] = mask[3, 4] = True
    want = np.zeros((4, 5), dtype=bool)
    want[:2, :2] = want[2:, 3:] = True
    assert (K.dilate(mask) == want).all()


def test_crop_falls_back_to_the_whole_picture():
    img = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert K.crop(img, 1, 1, 2, 2).tolist() == [[5, 6], [9, 10]]
    assert K.crop(img, 3, 0, 2, 2) is img


def test_rescale_point_and_linear():
    img = np.array([[0, 100], [200, 40]], dtype=np.uint8)
    assert K.rescale(img, 4, 2, "point").tolist() == [[0, 0, 100, 100], [200, 200, 40, 40]]
    assert K.rescale(img, 4, 2).tolist() == [[0, 25, 75, 100], [200, 160, 80, 40]]
    assert K.rescale(img, 2, 2) is img


def test_interlace_sums_by_hand():
    rng = np.random.default_rng(3)
    p, c, n = (rng.integers(0, 255, (9, 6)) for _ in range(3))
    alpha, gamma, delta = [0, 0], [0, 0], 0
    for y in range(2, 7):
        for x in range(6):
            ends = int(c[y - 1, x]) + int(c[y + 1, x])
            alpha[y & 1] += abs(ends - 2 * int(p[y, x]))
            alpha[1 - (y & 1)] += abs(ends - 2 * int(n[y, x]))
            delta += abs(ends - 2 * int(c[y, x]))
            gamma[1 - (y & 1)] += abs(2 * int(c[y, x]) - 2 * int(p[y, x]))
    assert K.interlace_sums(p, c, n) == (alpha, delta, gamma)


def test_outlier_pixels_by_hand():
    rng = np.random.default_rng(5)
    img = rng.integers(0, 40, (11, 9)).astype(np.uint8)
    img[5] = 200

    def odd(y, x, j):
        a, b, c = (int(img[k, x]) for k in (y - j, y, y + j))
        return (abs(a - b) + abs(c - b)) // 2 - abs(c - a) > 4

    want = 0
    for y in range(1, 10):
        for x in range(1, 8):
            steps = (1, 2) if 2 <= y < 9 else (1,)
            want += all(odd(y, x + i, j) for j in steps for i in (-1, 0, 1))
    assert want > 0 and K.outlier_pixels(img) == want


def test_repeated_lines_and_range():
    img = np.tile(np.arange(8, dtype=np.uint8)[None, :] * 20 + 20, (9, 1))
    img[8] += 40
    assert K.repeated_line_pixels(img) == 4 * 8
    y = np.full((4, 4), 100, dtype=np.uint8)
    u, v = np.full((2, 2), 128, dtype=np.uint8), np.full((2, 2), 128, dtype=np.uint8)
    y[0, 0], u[1, 1] = 240, 10
    assert K.out_of_range_pixels(y, u, v) == 5


def test_background_model_is_repeatable_and_survives_its_bytes():
    rng = np.random.default_rng(1)
    pictures = rng.integers(90, 110, (6, 30, 40)).astype(np.uint8)
    one, two = K.ZoneDetector(), K.ZoneDetector()
    for f, img in enumerate(pictures):
        a = one.masks(img, (0, 0, 40, 30), "cam", 1, f)
        b = two.masks(img, (0, 0, 40, 30), "cam", 1, f)
        two = K.ZoneDetector(two.dump())
        assert (a is None) == (b is None) == (f == 0)
        if a is not None:
            assert (a == b).all()
    assert one.dump() == two.dump()


def test_a_changed_zone_starts_a_new_model():
    img = np.full((30, 40), 100, dtype=np.uint8)
    z = K.ZoneDetector()
    assert z.masks(img, (0, 0, 40, 30), "cam", 1, 0) is None
    assert z.masks(img, (0, 0, 40, 30), "cam", 1, 1) is not None
    assert z.masks(img[:, :20], (0, 0, 20, 30), "cam", 1, 2) is None


def test_ssim_of_equal_pictures_is_one():
    img = np.random.default_rng(2).integers(0, 255, (16, 24))
    assert abs(K.ssim(img, img) - 1) < 1e-12
    assert K.ssim(img, 255 - img) < 0.5
