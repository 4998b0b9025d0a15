"""Rasters: GeoTIFF headers, windows and overviews read by range in the workers, tiles and patches as rows. Strips or tiles, 8 to 64 bits, uncompressed, Deflate, LZW or PackBits, with or without differencing.

A task reads a raster's header and the strips or tiles that its windows meet, never the whole file; a band of windows is a row of
work of its own, so one large raster is spread over tasks.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.operators import collection

_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
#: Pixels of a picture's longer side up to which statistics read it whole; larger ones by an overview or every so many pixels.
OVERVIEW = 2048


class Ranges:
    """A file as bytes that are read where they are asked for, by blocks."""

    BLOCK, KEPT = 1 << 16, 64

    def __init__(self, path: str):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        self.file = system.open_input_file(at)
        self.size = self.file.size()
        self.block = functools.lru_cache(self.KEPT)(self._block)

    def _block(self, k: int) -> bytes:
        return self.file.read_at(min(self.BLOCK, self.size - k * self.BLOCK), k * self.BLOCK)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, s: slice) -> bytes:
        a, e = max(0, s.start or 0), min(self.size, self.size if s.stop is None else s.stop)
        if e - a > self.BLOCK:
            return self.file.read_at(e - a, a)
        return b"".join(self.block(k)[max(0, a - k * self.BLOCK) : e - k * self.BLOCK] for k in range(a // self.BLOCK, -(-e // self.BLOCK))) if a < e else b""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def directories(data) -> list[dict[int, tuple]]:
    """The tags of each directory of bytes or Ranges."""
    e = {b"II": "<", b"MM": ">"}.get(data[:2])
    if e is None or struct.unpack(e + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, out, seen = struct.unpack(e + "I", data[4:8])[0], [], set()
    while at and at not in seen:
        seen.add(at)
        t: dict[int, tuple] = {0: (e,)}
        n = struct.unpack(e + "H", data[at : at + 2])[0]
        raw = data[at + 2 : at + 6 + 12 * n]
        for k in range(n):
            tag, kind, count = struct.unpack(e + "HHI", raw[12 * k : 12 * k + 8])
            size = _SIZE.get(kind, 1) * count
            p = struct.unpack(e + "I", raw[12 * k + 8 : 12 * k + 12])[0]
            body = raw[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else data[p : p + size]
            t[tag] = (body.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"{e}{count}{_CODE[kind]}", body) if kind in _CODE else (body,)
        out.append(t)
        at = struct.unpack(e + "I", raw[12 * n : 12 * n + 4])[0] if len(raw) >= 12 * n + 4 else 0
    return out


def header(data) -> dict:
    """width, height, bands, minx, miny, maxx, maxy, step_x, step_y, nodata, epsg."""
    t = directories(data)[0]
    w, h = t[256][0], t[257][0]
    sx, sy = t.get(33550, (1.0, 1.0))[:2]
    tie = t.get(33922, (0.0, 0.0, 0.0, 0.0, float(h), 0.0))
    x0, y0 = tie[3] - tie[0] * sx, tie[4] + tie[1] * sy
    keys = t.get(34735, ())
    geo = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    nodata = t.get(42113, ("",))[0]
    return {"width": w, "height": h, "bands": t.get(277, (1,))[0], "minx": x0, "miny": y0 - h * sy, "maxx": x0 + w * sx, "maxy": y0, "step_x": sx, "step_y": sy, "nodata": float(nodata) if nodata else None, "epsg": int(geo.get(3072) or geo.get(2048) or 0) or None}


def lzw(data: bytes) -> bytes:
    """TIFF's LZW, codes from the high bit, widths growing one early."""
    out, table, width, bits, held, last = [], [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits
            held &= (1 << bits) - 1
            if code == 256:
                table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return b"".join(out)
            if not last:
                word = table[code]
            else:
                word = table[code] if code < len(table) else last + last[:1]
                table.append(last + word[:1])
            out.append(word)
            last = word
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


_UNPACK = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: packbits}


def window(data, t: dict[int, tuple], row: int = 0, col: int = 0, h: int | None = None, w: int | None = None, step: int = 1) -> np.ndarray:
    """height x width x bands of a directory's window; every step-th pixel. Only the strips or tiles that it meets are read."""
    e, full_w, full_h, bands = t[0][0], t[256][0], t[257][0], t.get(277, (1,))[0]
    h, w = full_h - row if h is None else h, full_w - col if w is None else w
    kind = {1: "u", 2: "i", 3: "f"}[t.get(339, (1,))[0]]
    dtype = np.dtype(f"{e}{kind}{t.get(258, (1,))[0] // 8}")
    packed, predictor, apart = t.get(259, (1,))[0], t.get(317, (1,))[0], t.get(284, (1,))[0] == 2 and bands > 1
    if packed not in _UNPACK or predictor not in (1, 2) or (predictor == 2 and dtype.kind == "f"):
        raise ValueError("unsupported TIFF layout")
    tiled = 322 in t
    tw, th = (t[322][0], t[323][0]) if tiled else (full_w, min(t.get(278, (full_h,))[0], full_h))
    across, down = -(-full_w // tw), -(-full_h // th)
    deep = 1 if apart else bands
    out = np.zeros((h, w, bands), dtype.newbyteorder("="))
    at, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    for band in range(bands if apart else 1):
        for r in range(row // th, -(-(row + h) // th)):
            for c in range(col // tw, -(-(col + w) // tw)):
                k = band * across * down + r * across + c
                y, x = r * th, c * tw
                rows = th if tiled else min(th, full_h - y)
                if not sizes[k]:
                    continue  # a sparse block is zero
                block = np.frombuffer(_UNPACK[packed](data[at[k] : at[k] + sizes[k]]), dtype)[: rows * tw * deep].reshape(rows, tw, deep)
                if predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
                a, b, f, g = max(y, row), min(y + rows, row + h), max(x, col), min(x + tw, col + w)
                out[a - row : b - row, f - col : g - col, slice(band, band + 1) if apart else slice(None)] = block[a - y : b - y, f - x : g - x]
    return out[::step, ::step]


def pixels(data) -> np.ndarray:
    """height x width x bands of the first directory."""
    return window(data, directories(data)[0])


def overview(data) -> np.ndarray:
    """The picture for statistics: whole up to OVERVIEW pixels; else the largest overview that is no larger, else the smallest overview, else every so many pixels, strip by strip."""
    first, *rest = directories(data)
    side = lambda t: max(t[256][0], t[257][0])
    small = sorted((t for t in rest if t.get(254, (0,))[0] & 1), key=side)
    if side(first) <= OVERVIEW:
        return window(data, first)
    if small:
        return window(data, next((t for t in reversed(small) if side(t) <= OVERVIEW), small[0]))
    step = -(-side(first) // OVERVIEW)
    return np.concatenate([window(data, first, r, 0, 1)[:, ::step] for r in range(0, first[257][0], step)])


def encode(px: np.ndarray, x0: float, y0: float, step_x: float, step_y: float, epsg: int = 4326, nodata: float | None = None) -> bytes:
    """A GeoTIFF with one Deflate strip."""
    px = np.ascontiguousarray(px if px.ndim == 3 else px[..., None])
    h, w, b = px.shape
    body = zlib.compress(px.astype(px.dtype.newbyteorder("<")).tobytes())
    kind = {"u": 1, "i": 2, "f": 3}[px.dtype.kind]
    entries = [(256, "I", [w]), (257, "I", [h]), (258, "H", [px.dtype.itemsize * 8] * b), (259, "H", [8]), (262, "H", [2 if b >= 3 else 1]), (273, "I", [0]), (277, "H", [b]), (278, "I", [h]), (279, "I", [len(body)]), (339, "H", [kind] * b),
               (33550, "d", [step_x, step_y, 0.0]), (33922, "d", [0.0, 0.0, 0.0, x0, y0, 0.0]), (34735, "H", [1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg])]
    if nodata is not None:
        entries.append((42113, "s", [f"{nodata:g}\0".encode()]))
    at = 8 + 2 + 12 * len(entries) + 4
    extra, rows = b"", []
    code = {"H": 3, "I": 4, "d": 12, "s": 2}
    for tag, f, v in entries:
        raw = v[0] if f == "s" else struct.pack(f"<{len(v)}{f}", *v)
        rows.append([tag, code[f], len(raw) if f == "s" else len(v), raw])
    for r in rows:
        if len(r[3]) > 4:
            r.append(at + len(extra))
            extra += r[3] + b"\0" * (len(r[3]) % 2)
    start = at + len(extra)
    out = b"II*\0" + struct.pack("<IH", 8, len(rows))
    for r in rows:
        if r[0] == 273:
            r[3] = struct.pack("<I", start)
        out += struct.pack("<HHI", *r[:3]) + (struct.pack("<I", r[4]) if len(r) > 4 else r[3].ljust(4, b"\0"))
    return out + b"\0" * 4 + extra + body


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the .tif and .tiff files in a folder, subfolders too, or of one file; each once. Their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif*").load(path).select("path", "length")


META = "path string, width bigint, height bigint, bands int, minx double, miny double, maxx double, maxy double, step_x double, step_y double, nodata double, epsg int, error string"


def open_rasters(spark: SparkSession, path: str) -> DataFrame:
    """A row of metadata for each raster (META); error says why one can't be read. Its box is minx .. maxy in the raster's coordinates."""

    def run(it):
        names = [c.split()[0] for c in META.split(", ")]
        for pdf in it:
            out = []
            for p in pdf["path"]:
                try:
                    with Ranges(p) as data:
                        out.append({"path": p, **header(data), "error": None})
                except Exception as e:  # noqa: BLE001 - a bad file is a row
                    out.append({"path": p, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=names)

    return files(spark, path).mapInPandas(run, META)


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """path, band, p1, p99 of the valid pixels (not nodata; without nodata not 0) of each raster's overview."""

    def run(it):
        for pdf in it:
            for p in pdf["path"]:
                with Ranges(p) as data:
                    px, no = overview(data), header(data)["nodata"] or 0
                out = []
                for b in range(px.shape[2]):
                    v = px[..., b][px[..., b] != no]
                    lo, hi = np.percentile(v, [1, 99]) if v.size else (None, None)
                    out.append((p, b, lo, hi))
                yield pd.DataFrame(out, columns=["path", "band", "p1", "p99"])

    return files(spark, path).mapInPandas(run, "path string, band int, p1 double, p99 double")


def _missing(data, t: dict[int, tuple], nodata: float, x: dict) -> int:
    r, k, w, h = (int(x[n]) for n in ("row_off", "col_off", "w", "h"))
    return int((window(data, t, r, k, h, w) == nodata).all(2).sum())


def tiles(spark: SparkSession, path: str, patch: int = 512, overlap: float = 0.2, most_missing: float = 0.8, pad: bool = True) -> DataFrame:
    """path, row_off, col_off, w, h, missing of the sliding windows with at most that share of missing pixels. Padded windows count what is beyond the edge as missing."""
    meta = open_rasters(spark, path).where("error is null").select("path", "width", "height")
    grid = collection.sliding_tiles(meta, F.col("width"), F.col("height"), patch, overlap)
    grid = grid.groupBy("path", "row_off").agg(F.collect_list(F.struct("row_off", "col_off", "w", "h")).alias("windows"))  # a band of windows is one row of work

    def run(it):
        for pdf in it:
            for p, ws in zip(pdf["path"], pdf["windows"]):
                out = []
                with Ranges(p) as data:
                    t, no = directories(data)[0], header(data)["nodata"] or 0
                    for x in ws:
                        bad, full = _missing(data, t, no, x), int(x["w"] * x["h"])
                        if pad:
                            bad, full = bad + patch * patch - full, patch * patch
                        if bad / full <= most_missing:
                            out.append((p, *(int(x[n]) for n in ("row_off", "col_off", "w", "h")), bad / full))
                yield pd.DataFrame(out, columns=["path", "row_off", "col_off", "w", "h", "missing"])

    return grid.mapInPandas(run, "path string, row_off bigint, col_off bigint, w bigint, h bigint, missing double")


def patches(spark: SparkSession, path: str, assets: DataFrame, buffer: float | str = "20%", most_missing: float = 0.2, square: bool = True, geographic: bool = True) -> DataFrame:
    """id, path, row_off, col_off, w, h, minx .. maxy, missing: each asset's buffered window in each raster that it meets, clipped to the raster, if less than that share is missing. Assets meet rasters by cells as wide as a common raster."""
    from parcelflow.functions import boxes, geo
    from parcelflow.operators.spatial import extent_join
    from parcelflow.session import cut

    b = geo.buffered_bounds(*(F.col(c).cast("double") for c in boxes.Box._fields), buffer=buffer, square=square, geographic=geographic)
    want = assets.select("id", *(c.alias(n) for n, c in zip(boxes.Box._fields, b)))
    meta = cut(open_rasters(spark, path).where("error is null").select(F.col("path").alias("raster"), *boxes.Box._fields, "width", "height", "step_x", "step_y"))
    size = meta.agg(F.avg(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))).first()[0] or 1.0
    j = extent_join(want, meta, size)
    col = lambda n: F.col(f"r_{n}")
    at = lambda v, n: F.least(F.greatest(F.round(v), F.lit(0)), n).cast("bigint")
    c0, c1 = at((F.col("minx") - col("minx")) / col("step_x"), col("width")), at((F.col("maxx") - col("minx")) / col("step_x"), col("width"))
    r0, r1 = at((col("maxy") - F.col("maxy")) / col("step_y"), col("height")), at((col("maxy") - F.col("miny")) / col("step_y"), col("height"))
    w = j.select("id", col("raster").alias("path"), *boxes.Box._fields, r0.alias("row_off"), c0.alias("col_off"), (c1 - c0).alias("w"), (r1 - r0).alias("h")).where("w > 0 and h > 0")
    part = F.floor(F.col("row_off") / F.lit(4096)).alias("band"), F.pmod(F.xxhash64("id"), F.lit(16)).alias("part")
    grouped = w.groupBy("path", *part).agg(F.collect_list(F.struct("id", "row_off", "col_off", "w", "h", *boxes.Box._fields)).alias("windows"))
    cols = ["id", "path", "row_off", "col_off", "w", "h", *boxes.Box._fields, "missing"]

    def run(it):
        for pdf in it:
            for p, ws in zip(pdf["path"], pdf["windows"]):
                out = []
                with Ranges(p) as data:
                    t, no = directories(data)[0], header(data)["nodata"] or 0
                    for x in sorted(ws, key=lambda x: (x["row_off"], x["col_off"])):
                        missing = _missing(data, t, no, x) / int(x["w"] * x["h"])
                        if missing < most_missing:
                            out.append((x["id"], p, *(int(x[n]) for n in ("row_off", "col_off", "w", "h")), *(x[f] for f in boxes.Box._fields), missing))
                yield pd.DataFrame(out, columns=cols)

    return grouped.mapInPandas(run, f"id {dict(assets.dtypes)['id']}, path string, row_off bigint, col_off bigint, w bigint, h bigint, minx double, miny double, maxx double, maxy double, missing double")


def read_windows(windows: DataFrame) -> DataFrame:
    """windows (path, row_off, col_off, w, h; other columns stay) with channels, pixels of 8 bits (row by row; 16 bits and more are scaled from their p1 to p99 where the columns p1 and p99 are there, else cut) and x0, y0, sx, sy: the place of the window's first corner and the steps."""
    more = "channels int, pixels binary, x0 double, y0 double, sx double, sy double"
    schema = ", ".join([*(f"`{c}` {t}" for c, t in windows.dtypes), more])
    scaled = "p1" in windows.columns and "p99" in windows.columns

    def run(it):
        for pdf in it:
            got = []
            for p, part in pdf.groupby("path", sort=False):
                with Ranges(p) as data:
                    t, m = directories(data)[0], header(data)
                    for k, r in part.iterrows():
                        px = window(data, t, int(r["row_off"]), int(r["col_off"]), int(r["h"]), int(r["w"]))[..., :3]
                        if scaled and r["p1"] is not None and r["p99"] > r["p1"]:
                            px = np.clip((px.astype(float) - r["p1"]) / (r["p99"] - r["p1"]) * 255, 0, 255)
                        px = np.ascontiguousarray(np.clip(px, 0, 255).astype(np.uint8)[..., : 3 if px.shape[2] > 2 else 1])
                        got.append((k, px.shape[2], px.tobytes(), m["minx"] + r["col_off"] * m["step_x"], m["maxy"] - r["row_off"] * m["step_y"], m["step_x"], m["step_y"]))
            out = pd.DataFrame(got, columns=["__k", "channels", "pixels", "x0", "y0", "sx", "sy"]).set_index("__k")
            yield pdf.join(out)

    return windows.mapInPandas(run, schema)
