import gzip
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parcelflow.sources import geojson, imagery, raster, shapefile


def feature(fid, geometry, **props):
    f = {"type": "Feature", "geometry": geometry, "properties": props}
    return f | ({"id": fid} if fid is not None else {})


SQUARE = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]], [[0.5, 0.5], [0.5, 1], [1, 1], [0.5, 0.5]]]}
POINT = {"type": "Point", "coordinates": [1.5, -2.25]}
ALL = {
    "type": "FeatureCollection",
    "features": [
        feature("p", POINT, name='quo"te', n=1, f=1.5, b=True, z=None, tags=["a"], o={"k": 1}), feature("p", SQUARE, name="later"), feature(0, SQUARE, x=1), feature(None, SQUARE, id="own"), feature(None, POINT),
        feature("bad", {"type": "Polygon", "coordinates": "x"}), feature("none", None), feature("nan", {"type": "Point", "coordinates": []}), feature("l", {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}),
        feature("m", {"type": "MultiPolygon", "coordinates": [SQUARE["coordinates"], [[[9, 9], [10, 9], [10, 10], [9, 9]]]]}),
    ],
}


def test_collection(spark, tmp_path):
    (tmp_path / "c.geojson").write_text(json.dumps(ALL))
    for source in (ALL, str(tmp_path / "c.geojson")):
        rows = {r["id"]: r for r in geojson.read(spark, source, "kind").collect()}
        assert len(rows) == 6 and {"p", "0", "own", "l", "m"} <= set(rows) and any(i.startswith("gen_") for i in rows)
        assert rows["p"]["geom"]["type"] == "Point" and (rows["m"]["minx"], rows["m"]["maxy"]) == (0.0, 10.0)
    with pytest.raises(ValueError):
        geojson.read(spark, {"type": "Feature"})
    with pytest.raises(ValueError):
        geojson.read(spark, {"type": "FeatureCollection", "features": 1})
    with pytest.raises(TypeError):
        geojson.read(spark, 3)
    with pytest.raises(PySparkException):
        geojson.read(spark, str(tmp_path / "missing.json")).collect()
    (tmp_path / "f.json").write_text("{}")
    with pytest.raises(PySparkException):
        geojson.read(spark, str(tmp_path / "f.json")).collect()


def test_round_trip(spark, tmp_path):
    a = geojson.read(spark, ALL)
    images = spark.createDataFrame([("p", 1, "i1", "/x.jpg", '{"h":1}'), ("p", 0, "i0", "/y.jpg", "{}")], "asset_id string, ord bigint, id string, path string, p string").select("asset_id", "ord", "id", "path", F.from_json("p", "map<string,variant>").alias("props"))
    out = geojson.collection(a, images)
    by = {f["id"]: f for f in out["features"]}
    assert by["p"]["properties"]["name"] == 'quo"te' and by["p"]["properties"]["tags"] == ["a"] and by["p"]["properties"]["z"] is None
    assert [i["id"] for i in by["p"]["properties"]["image_assets"]] == ["i0", "i1"] and "image_assets" not in by["0"]["properties"]
    assert by["m"]["geometry"] == json.loads(json.dumps(ALL["features"][-1]["geometry"]), parse_int=float) and by["l"]["geometry"]["coordinates"] == [[0, 0], [3, 4]]
    assert "name" not in {f["id"]: f for f in geojson.collection(a, images, ["name", "image_assets"])["features"]}["p"]["properties"]
    geojson.write_lines(a, str(tmp_path / "lines"))
    again = geojson.read(spark, str(tmp_path / "lines"), lines=True)
    key = lambda df: sorted(map(str, df.select("id", "geom").collect()))
    b = a.where("id not like 'gen%'")
    assert key(again.where("id not like 'gen%'")) == key(b)


def test_feature(spark):
    f = feature(None, {"type": "MultiPolygon", "coordinates": [SQUARE["coordinates"]]}, id=0, image_assets=[{"id": "i", "path": "/a/b.jpg", "q": 1}, {"path": "/a/c.x.jpg"}, {"id": "bad"}, 3])
    asset, images = geojson.read_feature(spark, f)
    row = asset.first()
    assert row["geom"]["type"] == "Polygon" and row["id"].startswith("no_id_")
    assert [(r["id"], r["path"]) for r in images.orderBy("ord").collect()] == [("i", "/a/b.jpg"), ("c.x", "/a/c.x.jpg")]
    assert geojson.read_feature(spark, f, "mine")[0].first()["id"] == "mine"
    for bad in ({"type": "X"}, {"type": "Feature"}):
        with pytest.raises(ValueError):
            geojson.read_feature(spark, bad)


def test_shapefile(spark, tmp_path):
    a = geojson.read(spark, ALL)
    polys = a.where("geom.type like '%Polygon'")
    shapefile.write(polys, str(tmp_path / "out.shp"))
    assert (tmp_path / "out.prj").exists() and (tmp_path / "out.shx").stat().st_size == 100 + 8 * 3
    got = {r["id"]: r for r in shapefile.read(spark, str(tmp_path / "out.shp")).collect()}
    assert set(got) == {"0", "own", "m"} and len(got["m"]["geom"]["parts"]) == 2 and len(got["0"]["geom"]["parts"][0]) == 2
    pts = a.where("geom.type = 'Point' and id = 'p'")
    shapefile.write(pts, str(tmp_path / "pts.shp"), epsg=3857)
    assert not (tmp_path / "pts.prj").exists()
    r = shapefile.read(spark, str(tmp_path / "pts.shp")).select("*", F.to_json("attrs").alias("j")).first()
    attrs = json.loads(r["j"])
    assert attrs["n"] == 1 and attrs["f"] == 1.5 and attrs["b"] is True and attrs["tags"] == ["a"] and attrs["o"] == {"k": 1} and (r["minx"], r["miny"]) == (1.5, -2.25)
    many = shapefile.write(polys.repartition(3), str(tmp_path / "many"))
    assert all(x.startswith(f"{tmp_path}/many/part-") for x in many)
    again = shapefile.read(spark, str(tmp_path / "many")).collect()
    assert {r["id"]: r["geom"] for r in again} == {i: r["geom"] for i, r in got.items()}
    with pytest.raises(ValueError):
        shapefile.write(a.limit(0), str(tmp_path / "e.shp"))
    with pytest.raises(ValueError):
        shapefile.write(a, str(tmp_path / "e.shp"))


def test_null_shapes_and_ids():
    shp = b"\0" * 100 + struct.pack(">2i", 1, 2) + struct.pack("<i", 0) + struct.pack(">2i", 2, 10) + struct.pack("<i2d", 1, float("nan"), 1) + struct.pack(">2i", 3, 10) + struct.pack("<i2d", 1, 1, 2)
    assert shapefile.parse_shp(shp) == [None, None, {"type": "Point", "coordinates": [1.0, 2.0]}]


def test_rasters(spark, tmp_path):
    px = (np.arange(40 * 60 * 3) % 251).astype(np.uint8).reshape(40, 60, 3) + 1
    px[:, 30:] = 0
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.tif").write_bytes(raster.encode(px, -118.0, 34.0, 0.1, 0.1))
    (tmp_path / "bad.tiff").write_bytes(b"nope")
    meta = {r["path"].rsplit("/", 1)[1]: r for r in raster.open_rasters(spark, str(tmp_path)).collect()}
    m = meta["a.tif"]
    assert (m["width"], m["height"], m["bands"], m["epsg"]) == (60, 40, 3, 4326) and m["maxx"] == pytest.approx(-112) and m["miny"] == pytest.approx(30) and meta["bad.tiff"]["error"]
    assert (raster.pixels((tmp_path / "sub" / "a.tif").read_bytes()) == px).all()
    one = str(tmp_path / "sub")
    st = {r["band"]: r for r in raster.statistics(spark, one).collect()}
    lo, hi = np.percentile(px[..., 1][px[..., 1] != 0], [1, 99])
    assert st[1]["p1"] == lo and st[1]["p99"] == hi
    t = raster.tiles(spark, one, patch=20, overlap=0.0, most_missing=0.5, pad=False).collect()
    assert {(r["row_off"], r["col_off"]) for r in t} == {(r, c) for r in (0, 20) for c in (0, 20)}
    assets = spark.createDataFrame([("in", -117.5, 32.0, -117.0, 33.0), ("gone", -113.0, 32.0, -112.5, 33.0), ("far", 0.0, 0.0, 1.0, 1.0)], "id string, minx double, miny double, maxx double, maxy double")
    got = raster.patches(spark, one, assets).collect()
    assert [r["id"] for r in got] == ["in"] and got[0]["w"] >= 14


def tiff(px, tile=None, packed=1, predictor=1, order="<", apart=False, small=None):
    """A TIFF of our own: strips of 7 rows or tiles, packed, differenced, band by band, with an overview."""
    pages, out = [(px, 0)] + ([(small, 1)] if small is not None else []), bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    for n, (a, kind) in enumerate(pages):
        h, w, b = a.shape
        tw, th = tile or (w, 7)
        blocks = []
        for band in range(b if apart else 1):
            own = a[..., band : band + 1] if apart else a
            for r in range(0, h, th):
                for c in range(0, w, tw):
                    x = own[r : r + th, c : c + tw]
                    if tile:
                        x = np.pad(x, ((0, th - x.shape[0]), (0, tw - x.shape[1]), (0, 0)))
                    if predictor == 2:
                        x = np.diff(x, axis=1, prepend=np.zeros_like(x[:, :1]))
                    raw = x.astype(x.dtype.newbyteorder(order)).tobytes()
                    blocks.append({1: lambda v: v, 5: lzw_packed, 8: zlib.compress, 32773: lambda v: b"".join(bytes([257 - 3]) + v[i : i + 1] if v[i : i + 3] == v[i : i + 1] * 3 else bytes([len(v[i : i + 3]) - 1]) + v[i : i + 3] for i in range(0, len(v), 3))}[packed](raw))
        entries = [(254, "I", [kind]), (256, "I", [w]), (257, "I", [h]), (258, "H", [a.dtype.itemsize * 8] * b), (259, "H", [packed]), (277, "H", [b]), (284, "H", [2 if apart else 1]), (317, "H", [predictor]), (339, "H", [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]] * b)]
        entries += [(322, "I", [tw]), (323, "I", [th]), (324, "I", None), (325, "I", [len(x) for x in blocks])] if tile else [(273, "I", None), (278, "I", [th]), (279, "I", [len(x) for x in blocks])]
        entries.sort()
        at = len(out)
        assert at == struct.unpack(order + "I", out[4:8])[0] if n == 0 else True
        free = at + 6 + 12 * len(entries)
        offs, body = [], b""
        for x in blocks:
            offs.append(free + len(body))
            body += x
        free += len(body)
        rows, extra = b"", b""
        for tag, f, v in entries:
            v = offs if v is None else v
            raw = struct.pack(f"{order}{len(v)}{f}", *v)
            cell = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", free + len(extra))
            extra += b"" if len(raw) <= 4 else raw
            rows += struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[f], len(v)) + cell
        more = free + len(extra) if n + 1 < len(pages) else 0
        out += struct.pack(order + "H", len(entries)) + rows + struct.pack(order + "I", more) + body + extra
    return bytes(out)


def lzw_packed(data):
    table, width, bits, word = {bytes([k]): k for k in range(256)}, 9, [f"{256:09b}"], b""
    size = 258
    for k in range(len(data)):
        x = word + data[k : k + 1]
        if x in table:
            word = x
            continue
        bits.append(f"{table[word]:0{width}b}")
        table[x], size = size, size + 1
        word = data[k : k + 1]
        if size == 4094:
            bits.append(f"{256:0{width}b}")
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    bits += [f"{table[word]:0{width}b}"] if word else []
    size += 1
    width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    b = "".join(bits) + f"{257:0{width}b}"
    return int(b.ljust(-(-len(b) // 8) * 8, "0"), 2).to_bytes(-(-len(b) // 8), "big")


@pytest.mark.parametrize("packed", [1, 5, 8, 32773])
@pytest.mark.parametrize("layout", [{}, {"tile": (16, 16)}, {"order": ">", "apart": True}, {"predictor": 2, "tile": (32, 16)}])
def test_tiff_layouts_and_windows(tmp_path, packed, layout):
    r = np.random.default_rng(packed)
    for kind in (np.uint8, np.uint16):
        px = (r.integers(0, 40, (45, 70, 3)) ** 2).astype(kind)
        data = tiff(px, packed=packed, **layout)
        assert (raster.pixels(data) == px).all()
        (tmp_path / "x.tif").write_bytes(data)
        with raster.Ranges(str(tmp_path / "x.tif")) as f:
            t = raster.directories(f)[0]
            for a, b, h, w in ((0, 0, 45, 70), (3, 5, 20, 30), (44, 69, 1, 1), (15, 15, 2, 2)):
                assert (raster.window(f, t, a, b, h, w) == px[a : a + h, b : b + w]).all()


def test_long_lzw_and_overviews(monkeypatch):
    r = np.random.default_rng(3)
    raw = r.integers(0, 256, 30_000).astype(np.uint8).tobytes() + b"ab" * 9000
    assert raster.lzw(lzw_packed(raw)) == raw
    big, small = r.integers(0, 99, (60, 90, 1)).astype(np.uint8), np.full((6, 9, 1), 7, np.uint8)
    monkeypatch.setattr(raster, "OVERVIEW", 30)
    assert (raster.overview(tiff(big, small=small)) == small).all()
    assert (raster.overview(tiff(big)) == big[::3, ::3]).all()
    monkeypatch.setattr(raster, "OVERVIEW", 90)
    assert (raster.overview(tiff(big, small=small)) == big).all()


def test_patches_meet_rasters_without_a_nested_loop(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.tif").write_bytes(raster.encode(np.full((20, 20, 3), k + 1, np.uint8), k * 2.0, 2.0, 0.1, 0.1))
    assets = spark.createDataFrame([("a", 0.5, 0.5, 0.9, 0.9), ("b", 1.8, 0.5, 2.2, 0.9), ("c", 9.0, 9.0, 9.1, 9.1)], "id string, minx double, miny double, maxx double, maxy double")
    df = raster.patches(spark, str(tmp_path), assets, buffer=0.0, square=False)
    assert {(r["id"], r["path"][-5:]) for r in df.collect()} == {("a", "0.tif"), ("b", "0.tif"), ("b", "1.tif")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    px = raster.read_windows(df.select("id", "path", "row_off", "col_off", "w", "h")).collect()
    assert {(r["id"], bytes(r["pixels"])[0], len(r["pixels"])) for r in px} == {("a", 1, 48), ("b", 1, 24), ("b", 2, 24)}


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def block(field, data):
    return varint(field << 3 | 2) + varint(len(data)) + data


def vector_tile(points):
    """A tile whose layer `image` has points (sx, sy, properties)."""
    keys, values, feats = [], [], []
    for sx, sy, props in points:
        tags = []
        for k, v in props.items():
            raw = block(1, v.encode()) if isinstance(v, str) else varint(4 << 3) + varint(v)
            keys += [k] if k not in keys else []
            values += [raw] if raw not in values else []
            tags += [keys.index(k), values.index(raw)]
        z = lambda n: (n << 1) ^ (n >> 31)
        feats.append(block(2, b"".join(map(varint, tags))) + varint(3 << 3) + varint(1) + block(4, varint(9) + varint(z(sx)) + varint(z(sy))))
    layer = block(1, b"image") + b"".join(block(2, f) for f in feats) + b"".join(block(3, k.encode()) for k in keys) + b"".join(block(4, v) for v in values) + varint(5 << 3) + varint(4096)
    return gzip.compress(block(3, layer))


def test_tile_images(spark):
    def fetch(url):
        x, y = map(int, url.split("/")[-2:])
        if (x + y) % 2:
            raise OSError("down")
        day = 86_400_000 * (19_723 + x % 3)
        return vector_tile([(1024, 512, {"id": f"i{x}_{y}", "captured_at": day, "creator_id": "7"}), (2048, 2048, {"id": "same", "captured_at": day, "creator_id": "8"})])

    box = (-118.2, 34.0, -118.15, 34.04)
    got = imagery.images_in_box(spark, box, fetch, "mem/{z}/{x}/{y}", partitions=2).collect()
    failed = [r for r in got if r["error"]]
    assert failed and all("down" in r["error"] and r["id"] is None for r in failed)
    got = [r for r in got if not r["error"]]
    names = [r["id"] for r in got]
    assert names.count("same") == 1 and len(names) > 2
    r = next(r for r in got if r["id"] != "same")
    assert abs(r["plon"] + 118.18) < 0.1 and abs(r["plat"] - 34.02) < 0.1 and str(r["capture_date"]).startswith("2024-01-0")
    assert imagery.images_in_box(spark, box, fetch, "mem/{z}/{x}/{y}", creator="8").where("error is null").count() == 1
    assert imagery.images_in_box(spark, box, fetch, "mem/{z}/{x}/{y}", start="2030-01-01").where("error is null").count() == 0
    tiles = imagery.aerial_tiles(spark, (-118.1502, 34.18, -118.15, 34.1802), 18)
    q = tiles.first()
    assert len(q["quadkey"]) == 18 and q["minx"] < -118.15 < q["maxx"] + 0.01


def test_downloads_and_listing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, url string")

    def fetch(u):
        if u == "bad":
            raise ValueError("gone")
        return b"data"

    got = {r["id"]: r for r in imagery.fetched(rows, fetch, tries=1).collect()}
    assert bytes(got[1]["content"]) == b"data" and "gone" in got[2]["error"]
    (tmp_path / "a.jpg").write_bytes(b"x")
    (tmp_path / "b.jpg").write_bytes(b"")
    have = spark.createDataFrame([(1, f"{tmp_path}/a.jpg"), (2, f"{tmp_path}/b.jpg"), (3, f"{tmp_path}/c.jpg")], "id int, path string")
    assert [r["id"] for r in imagery.present(spark, have, str(tmp_path)).collect()] == [1]


def test_pictures(spark, tmp_path):
    from parcelflow.sources import pictures

    r = np.random.default_rng(0)
    for shape, kind in (((5, 7), np.uint8), ((4, 6, 3), np.uint8), ((3, 2), np.uint16)):
        px = r.integers(0, 255, shape).astype(kind)
        assert (pictures.png_pixels(pictures.png_bytes(px)) == px).all()
    with pytest.raises(ValueError):
        pictures.png_pixels(b"x")
    m = r.integers(0, 9, (8, 10)).astype(np.uint8)
    df = spark.createDataFrame([(f"{tmp_path}/a.jpg", 8, 10, bytearray(m.tobytes()))], "path string, h int, w int, mask binary")
    got = pictures.save_files(pictures.mask_files(df, "semantic")).collect()
    assert [(r["status"], r["path"]) for r in got] == [("saved", f"{tmp_path}/a_semantic.png")]
    assert pictures.save_files(pictures.mask_files(df, "semantic")).first()["status"] == "kept"
    (tmp_path / "bad.png").write_bytes(b"no")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in pictures.load(spark, str(tmp_path)).collect()}
    assert (np.frombuffer(bytes(rows["a_semantic.png"]["pixels"]), np.uint8).reshape(8, 10) == m).all() and rows["bad.png"]["error"]
    w = pictures.load(spark, str(tmp_path)).where("error is null").selectExpr("h", "w", "channels", "pixels", "2 as top", "5 as bottom", "8 as left", "3 as right")
    c = pictures.crop(w).first()
    assert (c["h"], c["w"]) == (3, 5) and (np.frombuffer(bytes(c["pixels"]), np.uint8).reshape(3, 5) == m[2:5][:, [8, 9, 0, 1, 2]]).all()
    with pytest.raises(ValueError):
        pictures.mask_files(df, "depth")
    i = spark.sql("""select 'i' as id, '/p' as path, map('path', parse_json('"own"'), 'q', parse_json('1')) as props""")
    assert pictures.image_table(i, ["path", "q"]).first().asDict() == {"id": "i", "path": "own", "is_downloaded": False, "q": "1"}
    assert json.loads(pictures.image_json(i).first()["json"])["props"] == {"path": "own", "q": 1}


def test_jpeg(spark, tmp_path):
    from parcelflow.kernels import jpeg
    from parcelflow.sources import pictures

    y, x = np.mgrid[:37, :50]
    colour = np.stack([x * 5, y * 6, 255 - x * 4], 2).clip(0, 255).astype(np.uint8)
    grey = ((np.sin(x / 5) + np.cos(y / 7)) * 60 + 128).astype(np.uint8)
    noise = np.random.default_rng(1).integers(0, 256, (33, 41, 3)).astype(np.uint8)
    exif = b"Exif\0\0II*\0" + struct.pack("<IHHHIHHI", 8, 1, 274, 3, 1, 6, 0, 0)
    data = {"c.jpg": jpeg.encode(colour, 95), "g.jpg": jpeg.encode(grey, 95), "n.jpg": jpeg.encode(noise, 100)}
    data["e.jpg"] = data["c.jpg"][:2] + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + data["c.jpg"][2:]
    data["bad.jpg"] = b"no"
    for n, d in data.items():
        (tmp_path / n).write_bytes(d)
    got = {r["path"].rsplit("/", 1)[1]: r for r in pictures.load_pictures(spark, str(tmp_path)).collect()}
    px = lambda n: np.frombuffer(bytes(got[n]["pixels"]), np.uint8).reshape(got[n]["h"], got[n]["w"], -1).astype(int)
    assert abs(px("c.jpg") - colour).max() < 20 and abs(px("c.jpg") - colour).mean() < 2
    assert abs(px("g.jpg")[..., 0] - grey).max() < 12 and abs(px("n.jpg") - noise).mean() < 3
    assert (px("e.jpg") == px("c.jpg")[::-1].swapaxes(0, 1)).all() and jpeg.orientation(data["e.jpg"]) == 6
    assert got["bad.jpg"]["error"]
    df = spark.createDataFrame([("k", 37, 50, 3, bytearray(colour.tobytes()))], "id string, h int, w int, channels int, pixels binary")
    assert bytes(pictures.encoded(df, quality=95).first()["content"]) == data["c.jpg"] and (pictures.png_pixels(bytes(pictures.encoded(df, "png").first()["content"])) == colour).all()


def test_orientations():
    from parcelflow.kernels import jpeg

    a = np.arange(6).reshape(2, 3)
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: np.rot90(a, 2).T, 8: np.rot90(a)}
    assert all((jpeg.upright(a, k) == w).all() for k, w in want.items())


def test_gallery(spark):
    from parcelflow.sources import pictures

    i = spark.createDataFrame([("a<b", "/d/x.jpg", 40, 30), ("c", "/d/y.jpg", 4, 3)], "id string, path string, w int, h int")
    p = spark.createDataFrame([("a<b", "roof & wall", [(1.0, 2.0), (3.0, 2.0), (3.0, 4.0)]), ("a<b", "short", [(1.0, 1.0)])], "id string, label string, points array<struct<x:double,y:double>>")
    got = {r["path"]: bytes(r["content"]).decode() for r in pictures.gallery(i, p).collect()}
    assert set(got) == {"/d/x.html", "/d/y.html"} and "polygon points" not in got["/d/y.html"]
    assert '<polygon points="1.0,2.0 3.0,2.0 3.0,4.0"><title>roof &amp; wall</title>' in got["/d/x.html"] and "short" not in got["/d/x.html"] and "<title>a&lt;b</title>" in got["/d/x.html"]


def test_images_by_id(spark):
    def fetch(u):
        if u.startswith("meta/"):
            i = u.split("/")[1].split("?")[0]
            if i == "gone":
                raise OSError("none")
            return json.dumps({"id": i, **({} if i == "bare" else {"thumb_original_url": f"pic/{i}"})}).encode()
        return b"P" + u.encode()

    got = {r["id"]: r for r in imagery.images_by_id(spark, ["x", "gone", "x", "bare"], fetch, "meta/{id}?fields={fields}", ["id", "height", "colour"], partitions=2, tries=1).collect()}
    assert bytes(got["x"]["content"]) == b"Ppic/x" and json.loads(got["x"]["props"])["id"] == "x" and got["x"]["error"] is None
    assert "none" in got["gone"]["error"] and got["bare"]["error"] == "no address of a picture" and len(got) == 3


def test_datasets(spark, tmp_path):
    from parcelflow.sources import datasets

    registry = {"Harbour": {"a.tif": "u/a", "b.tif": "u/bad"}, "hillside": {"c.tif": "u/c"}}
    assert datasets.names_of(registry, [" HARBOUR ", "hillside", "harbour"]) == ["Harbour", "hillside"] and datasets.names_of(registry) == ["Harbour", "hillside"]
    with pytest.raises(ValueError, match="did you mean 'hillside'"):
        datasets.names_of(registry, "hillsid")
    with pytest.raises(ValueError, match="there are"):
        datasets.names_of(registry, "zzz")

    def fetch(u):
        if u == "u/bad":
            raise OSError("gone")
        return u.encode()

    run = lambda: {r["path"].rsplit("/", 1)[1]: r["status"] for r in datasets.download(spark, registry, "harbour", str(tmp_path), fetch, tries=1).collect()}
    assert run() == {"a.tif": "saved", "b.tif": "failed"} and run() == {"a.tif": "kept", "b.tif": "failed"}
    assert (tmp_path / "Harbour" / "a.tif").read_bytes() == b"u/a"
