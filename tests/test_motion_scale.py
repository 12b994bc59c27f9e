"""Motion on many pictures: drawn and cut by many tasks, packed for the shuffle, one camera zone to a task."""

import numpy as np
import pandas as pd
from pyspark import TaskContext

from framewell.operators import kernels as K
from framewell.operators import motion as D
from framewell.plans import fixtures as V
from framewell.plans.service import clip_config


def plain_foreground(model, img):
    return (np.abs(model.astype(int) - img.astype(int)) <= K.RADIUS).sum(axis=0) < K.MIN_MATCHES


def plain_update(model, img, fg, rng):
    """One number below the factor for each pixel, then samples, then for the second lot neighbours."""
    for beside in (False, True):
        y, x = np.nonzero(~fg & (rng.integers(0, K.UPDATE_FACTOR, fg.shape, dtype=np.uint8) == 0))
        depth, value = rng.integers(0, K.N_SAMPLES, len(y)), img[y, x]
        if beside:
            y, x = K._beside(y, x, img.shape, rng)
        model[depth, y, x] = value


def test_model_equals_the_plain_form():
    rng = np.random.default_rng(4)
    for spread in (3, 15, 60, 255):  # few to all pixels are foreground
        base = rng.integers(0, 256, (31, 43))
        pictures = np.clip(base + rng.integers(-spread, spread + 1, (12, 31, 43)), 0, 255).astype(np.uint8)
        model = K.init_model(pictures[0], K.picture_rng("cam", 1, 0))
        plain = model.copy()
        for f, img in enumerate(pictures):
            fg = K.foreground(model, img)
            assert (fg == plain_foreground(plain, img)).all()
            K.update_model(model, img, fg, K.picture_rng("cam", 1, f))
            plain_update(plain, img, fg, K.picture_rng("cam", 1, f))
            assert (model == plain).all()


def test_pictures_are_drawn_by_many_tasks(spark, sf_dir):
    assert V.clips(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_zones_are_dealt_one_to_a_task(spark, sf_dir):
    clips = V.clips(spark, sf_dir)
    regions = D.zone_regions(clips.unionByName(clips).unionByName(clips), D.watched_zones(clip_config(spark, sf_dir)), packed=True)

    def step(pdf, state):
        seen = (pdf["token"].iloc[0], pdf["zone_id"].iloc[0], TaskContext.get().partitionId(), len(pdf), pdf["luma"].str.len().max())
        return pd.DataFrame([seen], columns=["token", "zone_id", "task", "n", "size"]), state

    got = D._by_zone(regions, step, "token STRING, zone_id INT, task INT, n INT, size INT").collect()
    zones = {(r.token, r.zone_id) for r in got}
    assert len(zones) == len({r.task for r in got}) == len({(r.token, r.zone_id, r.task) for r in got}) > 8
    assert max(r.n for r in got) <= D.MOST_PICTURES and max(r.size for r in got) < 5000


def test_packed_regions_and_many_zones_give_the_same(spark, sf_dir, monkeypatch):
    clips, watched = V.clips(spark, sf_dir), D.watched_zones(clip_config(spark, sf_dir))
    want = sorted(D.zone_motion_boxes(D.zone_regions(clips, watched)).collect())
    assert sorted(D.zone_motion_boxes(D.zone_regions(clips, watched, packed=True)).collect()) == want and want
    monkeypatch.setattr(D, "FEW_STREAMS", 3)
    assert sorted(D.zone_motion_boxes(D.zone_regions(clips, watched, packed=True)).collect()) == want
    masks = D.background_mask(D.zone_regions(clips, watched, packed=True)).collect()
    assert all(r.changed_pixels == r.mask.count(255) for r in masks) and any(r.changed_pixels for r in masks)


def test_noise_that_does_not_pack_stays():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8).tobytes()
    assert D._packed(data) == data == D._unpacked(data, 5000)
    assert D._unpacked(D._packed(bytes(5000)), 5000) == bytes(5000)
