"""Whole extractions over small made-up worlds."""

import json

import numpy as np
import pytest

from parcelflow.models import base
from parcelflow.plans import extract
from parcelflow.sources import pictures, raster

M = 1 / 111194.92664


def test_street_images(spark, tmp_path):
    box = lambda i, x, y, h: (i, x * M, y * M, (x - h) * M, (y - h) * M, (x + h) * M, (y + h) * M, 90.0)
    assets = spark.createDataFrame([box("a", 0, 0, 5), box("wall", 0, 20, 4), box("far", 9000, 0, 5)], "id string, lon double, lat double, minx double, miny double, maxx double, maxy double, axis_angle double")
    cams = spark.createDataFrame([(1, 30 * M, 1 * M, "east"), (2, 20 * M, 5 * M, "east2"), (3, 0.0, 40 * M, "north"), (4, -30 * M, 0.0, "bad"), (5, 200 * M, 0.0, "away")], "event_id int, plon double, plat double, url string")

    def fetch(u):
        if u == "bad":
            raise OSError("lost")
        return u.encode()

    got = {r["id"]: r for r in extract.street_images(assets, cams, fetch, str(tmp_path), size=30 * M).where("asset_id = 'a'").collect()}
    assert set(got) == {"a_major_pos", "a_major_neg"}  # the wall stands before the camera in the north
    assert json.loads(got["a_major_pos"]["props"])["event_id"] == 1 and (tmp_path / "a_major_pos.jpg").read_bytes() == b"east" and "lost" in got["a_major_neg"]["error"]


def test_aerial_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    px = np.zeros((40, 40, 3), np.uint16) + 1
    px[:, 20:] = 4000
    (tmp_path / "in" / "r.tif").write_bytes(raster.encode(px, 0.0, 4.0, 0.1, 0.1))
    assets = spark.createDataFrame([("a", 2.5, 1.0, 3.5, 2.0), ("b", 50.0, 1.0, 51.0, 2.0)], "id string, minx double, miny double, maxx double, maxy double")
    got = extract.aerial_images(spark, str(tmp_path / "in"), assets, str(tmp_path / "out")).collect()
    assert [(r["id"], r["asset_id"], r["error"]) for r in got] == [("a_r", "a", None)] and (tmp_path / "out" / "a_r.jpg").exists()
    shown = pictures.load_pictures(spark, str(tmp_path / "out")).first()
    assert shown["h"] == shown["w"] == 14 and np.frombuffer(bytes(shown["pixels"]), np.uint8).min() > 240


def test_ortho_assets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.tif").write_bytes(raster.encode(np.full((32, 64, 3), 9, np.uint8), 100.0, 50.0, 1.0, 1.0))

    class Model(base.Backend):
        def run(self, images, prompt, **options):
            first = images[0].endswith("_0_0.png")
            return base.ModelOutput(masks=[[[22, 4], [32, 4], [32, 8], [22, 8]]] if first else [], boxes=[] if first else [[0, 4, 6, 8]])

    got = extract.ortho_assets(spark, str(tmp_path / "in"), Model, "roofs", str(tmp_path / "tiles"), 20.0, patch=32, overlap=0.1).collect()
    areas = sorted(sum(abs(sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(r, [*r[1:], r[0]]))) / 2 for r in g["rings"]) for g in got)
    assert len(got) == 2 and sum(g["n"] for g in got) == 3 and areas == pytest.approx([24.0, 48.0])  # the tile at 28 goes on with the mask of the first


def test_mosaics_and_regions(spark, tmp_path):
    def fetch(u):
        z, x, y = map(int, u.split("/")[1:])
        if (x, y) == (9, 8):
            raise OSError("no tile")
        return pictures.png_bytes(np.full((256, 256, 3), (x * 16 + y) % 256, np.uint8))

    d = lambda px: px / (256 * 16) * 360 - 180
    boxes = spark.createDataFrame([("a", d(8 * 256 + 200), -20.0, d(9 * 256 + 50), 20.0)], "id string, minx double, miny double, maxx double, maxy double")
    m = extract.mosaics(boxes, fetch, "t/{z}/{x}/{y}", 4, 0.0).first()
    px = np.frombuffer(bytes(m["pixels"]), np.uint8).reshape(m["h"], m["w"], 3)
    assert m["x0"] in (8 * 256 + 199, 8 * 256 + 200) and m["w"] in range(105, 109)
    cut = 8 * 256 - m["y0"]
    assert (px[:cut, :56] == 135).all() and (px[:cut, 58:] == 151).all() and (px[cut:, :56] == 136).all() and (px[cut:, 58:] == 0).all()
    got = extract.region_rasters(spark, (d(7 * 256 + 10), -20.0, d(9 * 256 + 50), 20.0), fetch, "t/{z}/{x}/{y}", 4, str(tmp_path), block=2).collect()
    assert {r["path"].rsplit("/", 1)[1] for r in got} == {"3_3.tif", "3_4.tif", "4_3.tif", "4_4.tif"} and {r["status"] for r in got} == {"saved"}
    heads = [raster.header((tmp_path / n).read_bytes()) for n in ("3_3.tif", "4_3.tif", "3_4.tif")]
    assert heads[0]["epsg"] == 3857 and heads[0]["maxx"] == pytest.approx(heads[1]["minx"], abs=1e-3) and heads[0]["miny"] == pytest.approx(heads[2]["maxy"], abs=1e-3)
    assert (raster.pixels((tmp_path / "4_3.tif").read_bytes())[:, :200] == 135).all()
