"""Shapefiles: a reader (one task a file, by binaryFile) and a writer, one shapefile a partition or one in all; tasks write, the driver sees only their names."""

from __future__ import annotations

import json
import math
import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import attrs as A
from parcelflow.operators.keyed import keep_first
from parcelflow.sources import geojson
from parcelflow.sources.pictures import save

WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


def parse_shp(data: bytes) -> list[dict | None]:
    """A GeoJSON geometry for each record; null shapes, empty and NaN ones are None."""
    out: list[dict | None] = []
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        out.append(_shape(data[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def _shape(b: bytes) -> dict | None:
    kind = struct.unpack("<i", b[:4])[0] if len(b) >= 4 else 0
    if kind % 10 == 1:
        x, y = struct.unpack("<2d", b[4:20])
        return None if math.isnan(x) or math.isnan(y) else {"type": "Point", "coordinates": [x, y]}
    if kind % 10 == 8:
        n = struct.unpack("<i", b[36:40])[0]
        c = struct.unpack(f"<{2 * n}d", b[40 : 40 + 16 * n])
        pts = [list(p) for p in zip(c[::2], c[1::2])]
        return {"type": "MultiPoint", "coordinates": pts} if pts and not any(map(math.isnan, c)) else None
    if kind % 10 not in (3, 5):
        return None
    parts, points = struct.unpack("<2i", b[36:44])
    starts = [*struct.unpack(f"<{parts}i", b[44 : 44 + 4 * parts]), points]
    c = struct.unpack(f"<{2 * points}d", b[44 + 4 * parts : 44 + 4 * parts + 16 * points])
    if not points or any(map(math.isnan, c)):
        return None
    rings = [[list(p) for p in zip(c[2 * s : 2 * e : 2], c[2 * s + 1 : 2 * e : 2])] for s, e in zip(starts, starts[1:])]
    if kind % 10 == 3:
        return {"type": "LineString", "coordinates": rings[0]} if len(rings) == 1 else {"type": "MultiLineString", "coordinates": rings}
    polys: list[list] = []
    for r in rings:  # outer rings are clockwise, holes follow theirs
        if _signed(r) <= 0 or not polys:
            polys.append([r])
        else:
            polys[-1].append(r)
    return {"type": "Polygon", "coordinates": polys[0]} if len(polys) == 1 else {"type": "MultiPolygon", "coordinates": polys}


def _signed(r: list[list[float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2


def parse_dbf(data: bytes) -> list[dict]:
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        f = data[at : at + 32]
        fields.append((f[:11].split(b"\0")[0].decode("latin-1"), chr(f[11]), f[16], f[17]))
        at += 32
    rows = []
    for k in range(n):
        r, p, row = data[head + k * size : head + (k + 1) * size], 1, {}
        for name, kind, width, places in fields:
            raw = r[p : p + width].decode("utf-8", "replace").strip("\0 ")
            p += width
            if kind in "NF":
                row[name] = None if raw in ("", "*" * len(raw)) else float(raw) if places or "." in raw else int(raw)
            elif kind == "L":
                row[name] = {"T": True, "Y": True, "F": False, "N": False}.get(raw[:1].upper())
            else:
                row[name] = raw
        rows.append(row)
    return rows


def features_of(shp: bytes, dbf: bytes) -> list[dict]:
    """Features with ids (from `id`, else `ID`, else made up), JSON-looking text parsed."""
    out = []
    for g, row in zip(parse_shp(shp), parse_dbf(dbf)):
        if g is None:
            continue
        own = next((row.pop(k) for k in ("id", "ID") if k in row), None)
        own = str(own).strip() if own is not None else ""
        props = {}
        for k, v in row.items():
            if isinstance(v, str) and v[:1] in "{[" and v:
                try:
                    props[k] = json.loads(v)
                except ValueError:
                    props["images_raw_str" if k == "images" else k] = v
            else:
                props[k] = v
        out.append({"type": "Feature", "id": own or f"gen_{uuid.uuid4().hex}", "geometry": g, "properties": props})
    return out


def read(spark: SparkSession, path: str, asset_type: str | None = None, overwrite_asset_type: bool = False) -> DataFrame:
    """Assets of a shapefile or a folder of them (.shp beside .dbf), as geojson.read gives them; of repeated ids the first stays."""
    glob = path[:-4] + ".*" if path.lower().endswith(".shp") else path
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob)
    base = F.regexp_replace("path", r"\.[^./]*$", "")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    both = files.groupBy(base.alias("base")).agg(F.max_by("content", F.when(kind == "shp", F.lit(1))).alias("shp"), F.max_by("content", F.when(kind == "dbf", F.lit(1))).alias("dbf")).where("shp is not null and dbf is not null")

    def run(it):
        import pandas as pd

        for pdf in it:
            for b, s, d in zip(pdf["base"], pdf["shp"], pdf["dbf"]):
                x = features_of(bytes(s), bytes(d))
                yield pd.DataFrame({"base": [b] * len(x), "n": range(len(x)), "j": [json.dumps(f) for f in x]})

    rows = both.mapInPandas(run, "base string, n bigint, j string")
    order = F.conv(F.substring(F.md5("base"), 1, 7), 16, 10).cast("bigint") * (1 << 32) + F.col("n")
    return geojson._assets(rows.select(order.alias("ord"), F.parse_json("j").alias("f")), asset_type, overwrite_asset_type)


_KIND = {"Point": 1, "LineString": 3, "MultiLineString": 3, "Polygon": 5, "MultiPolygon": 5, "MultiPoint": 8}


def _body(kind: str, parts: list) -> bytes:
    rings = [[(p["x"], p["y"]) for p in r] for part in parts for r in part]
    if kind == "Point":
        return struct.pack("<i2d", 1, *rings[0][0])
    pts = [p for r in rings for p in r]
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    box = struct.pack("<4d", min(xs), min(ys), max(xs), max(ys))
    flat = b"".join(struct.pack("<2d", *p) for p in pts)
    if kind == "MultiPoint":
        return struct.pack("<i", 8) + box + struct.pack("<i", len(pts)) + flat
    if _KIND[kind] == 5:  # outer rings clockwise, holes the other way
        rings = [r[::-1] if (_signed([list(p) for p in r]) > 0) == (k == 0) else r for part in parts for k, r in enumerate([[(p["x"], p["y"]) for p in q] for q in part])]
        flat = b"".join(struct.pack("<2d", *p) for r in rings for p in r)
    starts, n = [], 0
    for r in rings:
        starts.append(n)
        n += len(r)
    return struct.pack("<i", _KIND[kind]) + box + struct.pack("<2i", len(rings), n) + struct.pack(f"<{len(starts)}i", *starts) + flat


def encode(rows: list[dict], fields: list[tuple[str, str]], names: dict[str, str], kind: int) -> dict[str, bytes]:
    """The .shp, .shx and .dbf of rows (id, geom, attrs). fields: (key, type code)."""
    width = {"C": 254, "N": 18, "F": 18, "L": 1}
    shapes = [_body(r["geom"]["type"], r["geom"]["parts"]) for r in rows]
    offs, at = [], 50
    for s in shapes:
        offs.append(at)
        at += 4 + len(s) // 2
    pts = [(p["x"], p["y"]) for r in rows for part in r["geom"]["parts"] for ring in part for p in ring]
    box = struct.pack("<4d", min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts))
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i", 1000, kind) + box + b"\0" * 32
    size = 1 + sum(width[c] for _, c in fields)
    dbf = [struct.pack("<B3BIHH20x", 3, 126, 1, 1, len(rows), 33 + 32 * len(fields), size)]
    for k, c in fields:
        dbf.append(names[k].encode("latin-1", "replace")[:10].ljust(11, b"\0") + c.encode() + b"\0" * 4 + bytes([width[c], 5 if c == "F" else 0]) + b"\0" * 14)
    dbf.append(b"\r")
    for r in rows:
        dbf.append(b" " + b"".join(_cell(r["id"] if k == "id" else r["attrs"].get(k), c, width[c], k == "id") for k, c in fields))
    return {
        ".shp": head(at) + b"".join(struct.pack(">2i", k + 1, len(s) // 2) + s for k, s in enumerate(shapes)),
        ".shx": head(50 + 4 * len(shapes)) + b"".join(struct.pack(">2i", o, len(s) // 2) for o, s in zip(offs, shapes)),
        ".dbf": b"".join(dbf) + b"\x1a",
    }


def write(assets: DataFrame, path: str, epsg: int = 4326) -> list[str]:
    """Shapefiles of .shp, .shx, .dbf, and .prj for EPSG 4326; gives their .shp paths. A path that ends in .shp is one shapefile, of rows in order, written by one task; any other is a folder with one for each partition of the rows' order, on storage that all workers share. ValueError for an empty collection or mixed kinds of shape. Field types by attrs.shapefile_schema, text cut to 254 bytes."""
    kinds = {_KIND[r[0]] for r in assets.select("geom.type").distinct().collect()}
    if not kinds:
        raise ValueError("cannot write an empty collection")
    if len(kinds) > 1:
        raise ValueError("a shapefile holds one kind of shape")
    kind = kinds.pop()
    schema = [(r["key"], r["code"]) for r in A.shapefile_schema(assets).orderBy("place").collect() if r["key"] != "id"]
    names = A.short_names(["id", *(k for k, _ in schema)])
    fields = [("id", "C"), *schema]
    one = path.lower().endswith(".shp")
    rows = assets.select("ord", "id", F.to_json("geom").alias("geom"), F.to_json(F.transform_values("attrs", lambda _, v: F.to_json(v))).alias("attrs"))
    rows = (rows.repartition(1) if one else rows.repartitionByRange("ord")).sortWithinPartitions("ord")

    def run(it):
        import pandas as pd
        from pyspark import TaskContext

        got = [{"id": i, "geom": json.loads(g), "attrs": json.loads(a)} for pdf in it for i, g, a in pdf[["id", "geom", "attrs"]].itertuples(index=False)]
        if got:
            base = path[:-4] if one else f"{path}/part-{TaskContext.get().partitionId():05d}"
            for ending, data in {**encode(got, fields, names, kind), **({".prj": WGS84.encode()} if epsg == 4326 else {})}.items():
                save(base + ending, data)
            yield pd.DataFrame({"path": [f"{base}.shp"]})

    return sorted(r[0] for r in rows.mapInPandas(run, "path string").collect())


def _cell(raw: str | None, code: str, width: int, plain: bool = False) -> bytes:
    v = raw if plain or raw is None else json.loads(raw)
    if code == "L":
        return b"?" if v is None else b"T" if v else b"F"
    if code in "NF":
        return ("" if v is None else f"{float(v):.5f}" if code == "F" else str(int(v))).rjust(width)[:width].encode()
    s = "" if v is None else v if isinstance(v, str) else json.dumps(v)
    return s.encode()[:width].ljust(width)
