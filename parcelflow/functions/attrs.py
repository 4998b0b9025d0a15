"""Open attributes: MAP<STRING, VARIANT>. A key that is there with null differs from one that isn't there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE_KEYS = ("asset_type", "type", "category", "feature_type")
OPERATORS = ("==", "!=", ">", ">=", "<", "<=", "in", "contains", "exists")


def has(attrs: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(attrs, key), F.lit(False))


def value(attrs: Column, key: str) -> Column:
    return F.try_element_at(attrs, F.lit(key))


def kind(v: Column) -> Column:
    """bool, number, string, list, object or null, of a variant."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (s == "VOID"), "null").when(s == "BOOLEAN", "bool").when(s == "STRING", "string").when(s.startswith("ARRAY"), "list").when(s.startswith("OBJECT"), "object").otherwise("number")
    )


def number(v: Column) -> Column:
    """Numbers and truth values as double, else null: text isn't parsed."""
    return F.when(kind(v) == "number", F.try_variant_get(v, "$", "double")).when(kind(v) == "bool", F.try_variant_get(v, "$", "boolean").cast("double"))


def text(v: Column) -> Column:
    return F.when(kind(v) == "string", F.try_variant_get(v, "$", "string"))


def asset_type(attrs: Column) -> Column:
    """The value of the first type key that is there, be it null or empty; null if none is."""
    out = F.lit(None).cast("variant")
    for k in reversed(TYPE_KEYS):
        out = F.when(has(attrs, k), value(attrs, k)).otherwise(out)
    return F.try_variant_get(out, "$", "string")


def truthy(v: Column) -> Column:
    return F.when(kind(v) == "string", text(v) != "").when(kind(v).isin("number", "bool"), number(v) != 0).when(kind(v) == "null", F.lit(False)).otherwise(~F.to_json(v).isin("[]", "{}"))


def resolved_type(attrs: Column) -> Column:
    """The first type key with a value that isn't empty, else `Unknown`."""
    return F.coalesce(*(F.when(has(attrs, k) & truthy(value(attrs, k)), F.try_variant_get(value(attrs, k), "$", "string")) for k in TYPE_KEYS), F.lit("Unknown"))


def with_attributes(attrs: Column, new: dict[str, object], overwrite: bool = False) -> Column:
    """Attributes with others added; keys that are there stay as they are unless overwrite."""
    if not isinstance(new, dict):
        raise TypeError("attributes must be a dict")
    if not new:
        return attrs
    keys = list(new)
    as_variant = lambda x: x.cast("variant") if isinstance(x, Column) else F.parse_json(F.lit(_json(x)))
    add = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(as_variant(new[k]) for k in keys)))
    old = F.coalesce(attrs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    if overwrite:
        return F.map_concat(F.map_filter(old, lambda k, _: ~k.isin(keys)), add)
    return F.map_concat(old, F.map_filter(add, lambda k, _: ~F.map_contains_key(old, k)))


def _json(x: object) -> str:
    import json

    return json.dumps(x, default=str)


def only(attrs: Column, *keys: str) -> Column:
    return F.map_filter(attrs, lambda k, _: k.isin(list(keys)))


def without(attrs: Column, *keys: str) -> Column:
    return F.map_filter(attrs, lambda k, _: ~k.isin(list(keys)))


def with_type(attrs: Column, new: str, overwrite: bool = True) -> Column:
    """Sets the primary type key; without overwrite only where that key isn't there."""
    return with_attributes(attrs, {TYPE_KEYS[0]: new}, overwrite)


def property_or(props: Column, key: str, default: str | None = None, of: str = "string") -> Column:
    """A property, or the default where it isn't there; a null that is there stays null."""
    return F.when(has(props, key), F.try_variant_get(value(props, key), "$", of)).otherwise(F.lit(default).cast(of))


def _equals(v: Column, target: object) -> Column:
    if target is None:
        return kind(v) == "null"
    if isinstance(target, (bool, int, float)):
        return F.coalesce(number(v) == float(target), F.lit(False))
    if isinstance(target, str):
        return F.coalesce(text(v) == target, F.lit(False))
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(_json(target))))


def matches(attrs: Column, key: str, target: object = None, operator: str = "==") -> Column:
    """A typed comparison: false where the key isn't there, for != too, and where the types can't be compared."""
    if operator not in OPERATORS:
        raise ValueError(f"Unsupported operator {operator!r}; one of {', '.join(OPERATORS)}")
    v = value(attrs, key)
    if operator == "exists":
        return has(attrs, key)
    if operator == "==":
        test = _equals(v, target)
    elif operator == "!=":
        test = ~_equals(v, target)
    elif operator == "in":
        if isinstance(target, str):
            test = F.coalesce(F.lit(target).contains(text(v)), F.lit(False))
        else:
            test = F.lit(False)
            for t in target:
                test = test | _equals(v, t)
    elif operator == "contains":
        inside = F.lit(False)
        items = F.try_variant_get(v, "$", "array<variant>")
        listed = F.coalesce(F.exists(items, lambda x: _equals(x, target)), F.lit(False))
        if isinstance(target, str):
            inside = F.coalesce(text(v).contains(target), F.lit(False))
            keyed = F.coalesce(F.map_contains_key(F.try_variant_get(v, "$", "map<string,variant>"), target), F.lit(False))
            test = F.when(kind(v) == "string", inside).when(kind(v) == "list", listed).when(kind(v) == "object", keyed).otherwise(F.lit(False))
        else:
            test = F.when(kind(v) == "list", listed).otherwise(F.lit(False))
    else:
        own = number(v) if isinstance(target, (bool, int, float)) else text(v) if isinstance(target, str) else F.lit(None).cast("string")
        t = F.lit(float(target)) if isinstance(target, (bool, int, float)) else F.lit(target)
        test = {">": own > t, ">=": own >= t, "<": own < t, "<=": own <= t}[operator]
    return has(attrs, key) & F.coalesce(test, F.lit(False))


def filter_by_attribute(df: DataFrame, key: str, target: object = None, operator: str = "==", attrs: str = "attrs") -> DataFrame:
    return df.where(matches(F.col(attrs), key, target, operator))


def filter_empty(df: DataFrame, attrs: str = "attrs") -> DataFrame:
    """Rows with an attribute at least."""
    return df.where(F.size(attrs) > 0)


def filter_by_property(df: DataFrame, key: str, target: object, props: str = "props") -> DataFrame:
    """A property's equality; one that isn't there equals null."""
    v = value(F.col(props), key)
    return df.where(~has(F.col(props), key) | (kind(v) == "null") if target is None else has(F.col(props), key) & _equals(v, target))


def shapefile_schema(df: DataFrame, attrs: str = "attrs", order: str = "ord") -> DataFrame:
    """key, place, code, column: one type for each key over all rows. L truth values, N integers, F numbers, C text; N and F make F, other mixtures C; null counts as text. column: ten characters at most, made unique by a number."""
    v = F.col("value")
    s = F.schema_of_variant(v)
    code = F.when(v.isNull() | (s == "VOID"), "C").when(s == "BOOLEAN", "L").when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "N").when(s.isin("DOUBLE", "FLOAT") | s.startswith("DECIMAL"), "F").otherwise("C")
    rows = df.select(order, F.posexplode(F.map_entries(attrs)).alias("__p", "__e")).select(F.col("__e.key").alias("key"), F.col("__e.value").alias("value"), F.struct(F.col(order), F.col("__p")).alias("__at"))
    kinds = rows.select("key", code.alias("c"), "__at").groupBy("key").agg(F.collect_set("c").alias("cs"), F.min("__at").alias("place"))
    one = F.when(F.size("cs") == 1, F.col("cs")[0]).when((F.size("cs") == 2) & F.array_contains("cs", "N") & F.array_contains("cs", "F"), "F").otherwise("C")
    return kinds.select("key", "place", one.alias("code"))


def short_names(keys: list[str], longest: int = 10) -> dict[str, str]:
    """Column names of ten characters at most, later clashes numbered."""
    out: dict[str, str] = {}
    for k in keys:
        name, n = k[:longest], 1
        while name in out.values():
            name, n = k[: longest - len(str(n))] + str(n), n + 1
        out[k] = name
    return out
