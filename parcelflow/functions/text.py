"""Answers, labels, names: text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_answer(text: Column) -> Column:
    """MAP<STRING, VARIANT> of a model's answer: the object in a json fence or the whole text if that is a JSON object, else its `key: value` lines. Of equal keys the last counts (the lines are reduced to it; no session setting is needed)."""
    fenced = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    parsed = F.try_parse_json(body)
    as_map = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.try_variant_get(parsed, "$", "map<string,variant>"))
    return F.coalesce(as_map, key_value_lines(text))


def key_value_lines(text: Column) -> Column:
    """MAP<STRING, VARIANT> of lines `words: value` or `words - value`; keys in lower case, blanks as underscores; of equal keys the last counts. Two passes over the text, whatever its lines."""
    pattern = r"(?mU)^([\w\s&&[^\n\r]]+)[:\-][\s&&[^\n\r]]*(.*)$"
    key = lambda k: F.replace(F.lower(F.trim(k)), F.lit(" "), F.lit("_"))
    found = F.struct(F.reverse(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), key)).alias("k"), F.reverse(F.regexp_extract_all(text, F.lit(pattern), F.lit(2))).alias("v"))
    last = lambda s: F.transform(F.array_distinct(s["k"]), lambda k: F.trim(F.element_at(s["v"], F.array_position(s["k"], k).cast("int"))).cast("variant"))
    return F.transform(F.array(found), lambda s: F.map_from_arrays(F.array_distinct(s["k"]), last(s)))[0]  # the struct is computed once, not for each key


def prefixed(answer: Column, prefix: str) -> Column:
    return F.transform_keys(answer, lambda k, _: F.concat(F.lit(f"{prefix}_"), k))


def labels_in(text: Column, valid: list[str] | None = None) -> Column:
    """The strings of the first JSON list in a text, of the valid ones only; none gives an empty list."""
    found = F.coalesce(F.from_json(F.regexp_extract(text, r"(?s)(\[.*?\])", 1), "array<string>"), F.array().cast("array<string>"))
    return F.array_intersect(found, F.array(*map(F.lit, valid))) if valid is not None else F.array_distinct(found)


def json_or_text(s: Column) -> Column:
    """A variant: parsed if it looks like a JSON list or object and is one, else the text."""
    return F.when(s.startswith("{") | s.startswith("["), F.coalesce(F.try_parse_json(s), s.cast("variant"))).otherwise(s.cast("variant"))


def starts_with_any(s: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | s.startswith(p)
    return out


def split_base(s: Column) -> Column:
    return F.split(s, "_split_")[0]


def coordinate_name(prefix: str, lat: Column, lon: Column) -> Column:
    return F.replace(F.format_string("%s_%.8f_%.8f", F.lit(prefix), lat.cast("double"), lon.cast("double")), F.lit("."), F.lit(""))


def shortened(s: Column, keep: int) -> Column:
    """Cut with three dots beyond keep + 3 characters."""
    return F.when(F.length(s) > keep + 3, F.concat(F.substring(s, 1, keep), F.lit("..."))).otherwise(s)


KINDS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp", "gif": "gif", "bmp": "bmp", "tif": "tiff", "tiff": "tiff"}


def mime_of(path: str) -> str:
    """What mime gives, outside of a plan."""
    return f"image/{KINDS.get(path.rpartition('.')[2].lower(), 'jpeg')}"


def mime(path: Column) -> Column:
    """By extension; JPEG for unknown ones."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit("image/jpeg")
    for e, k in KINDS.items():
        out = F.when(ext == e, f"image/{k}").otherwise(out)
    return out


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(filename(path), r"(?<=.)\.[^.]*$", "")


MASK_TYPES = ("semantic", "instance")


def mask_path(path: Column, mask_type: str) -> Column:
    if mask_type not in MASK_TYPES:
        raise ValueError(f"mask type must be one of {MASK_TYPES}")
    return F.concat(directory(path), F.lit("/"), stem(path), F.lit(f"_{mask_type}.png"))


IMAGE_FIELDS = ("id", "geometry", "captured_at", "compass_angle", "is_pano", "creator", "sequence", "thumb_original_url", "computed_geometry", "computed_compass_angle", "altitude", "height", "width", "camera_type", "detections")


def checked_fields(fields: Column, valid: tuple[str, ...] = IMAGE_FIELDS, always: str = "thumb_original_url") -> Column:
    """The valid ones of the asked fields and the one that is always needed; null if none is valid."""
    good = F.array_intersect(fields, F.array(*map(F.lit, valid)))
    return F.when(F.size(good) > 0, F.array_union(good, F.array(F.lit(always))))


def in_date_range(day: Column, start: str | None, end: str | None) -> Column:
    """Bounds included; a bound that is no date doesn't bind; a null date passes only without bounds."""
    lo, hi = F.to_date(F.try_to_timestamp(F.lit(start), F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(F.lit(end), F.lit("yyyy-MM-dd")))
    given = F.lit(bool(start or end))
    return F.when(day.isNull(), ~given).otherwise(F.coalesce(day >= lo, F.lit(True)) & F.coalesce(day <= hi, F.lit(True)))
