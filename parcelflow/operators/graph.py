"""Connected components and what is dissolved by them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelflow.functions import boxes
from parcelflow.operators.spatial import box_join
from parcelflow.session import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root: the smallest id that edges (a, b) link each of nodes (id) to. Alternating large-star and small-star steps: the number of rounds grows with the logarithm of the size, and no round makes more edges than there are."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # written, so that a node of many neighbours can be split in the join
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = cut(small.where("u <> v").distinct())
        roots = new.select(F.col("v").alias("u")).distinct()
        if new.select("u").distinct().join(roots, "u", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            break
        e = new
    return nodes.select("id").join(new.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def overlap_edges(df: DataFrame, key: str, size: float, more_than: float = 0.5) -> DataFrame:
    """a, b: pairs of boxes whose common area is more than that share of the smaller one."""
    a, b = boxes.box("l_"), boxes.box("r_")
    j = box_join(df.select(key, *boxes.Box._fields), df.select(key, *boxes.Box._fields), size, on=F.col(f"l_{key}") < F.col(f"r_{key}"), inner_only=True)
    return j.where(boxes.overlap_area(a, b) > more_than * F.least(boxes.area(a), boxes.area(b))).select(F.col(f"l_{key}").alias("a"), F.col(f"r_{key}").alias("b"))


def dissolve(df: DataFrame, key: str, size: float, more_than: float = 0.5) -> DataFrame:
    """root, n, envelope: groups of boxes that overlap, directly or through others. Attributes don't survive."""
    comp = components(df.select(F.col(key).alias("id")), overlap_edges(df, key, size, more_than))
    return df.join(comp, df[key] == comp["id"]).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


#: Edges that a task holds before it drops those that no spanning tree needs.
HELD = 500_000


def _forest(e: pd.DataFrame) -> pd.DataFrame:
    """The edges of a minimum spanning forest of each group, by Kruskal's scan."""
    root: dict = {}

    def find(i):
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    e = e.sort_values(["w", "a", "b"])
    keep = []
    for g, a, b in zip(e["group"].tolist(), e["a"].tolist(), e["b"].tolist()):
        x, y = find((g, a)), find((g, b))
        keep.append(x != y)
        root[x] = y
    return e[keep]


def line_edges(nodes: DataFrame, at: str) -> DataFrame:
    """group, a, b, w: of points on a line (group, `at`) the pairs that follow each other. Any other pair is as long as the steps between, so a minimum spanning tree of all pairs is one of these."""
    after = F.lead(at).over(Window.partitionBy("group").orderBy(at))
    return nodes.select("group", F.col(at).alias("a"), after.alias("b")).where("b is not null").select("group", "a", "b", (F.col("b") - F.col("a")).cast("double").alias("w"))


def bottleneck(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """group, gap: the longest edge of each group's minimum spanning tree. nodes: group, id; edges: group, a, b, w, of all pairs or those that have a tree among them (as line_edges gives). Tasks drop edges that their own share of the edges makes needless, so no more than a tree's edges of each task meet in a group."""
    e = edges.select("group", "a", "b", "w")
    t = dict(e.dtypes)

    def reduced(it):
        held: list = []
        for pdf in it:
            held.append(pdf)
            if sum(map(len, held)) > HELD + len(held[0]):
                held = [_forest(pd.concat(held))]
        if held:
            yield _forest(pd.concat(held))

    def run(key, e: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"group": [key[0]], "gap": [max(0.0, _forest(e)["w"].max())]})

    few = e.mapInPandas(reduced, ", ".join(f"`{c}` {t[c]}" for c in e.columns))
    found = few.groupBy("group").applyInPandas(run, f"group {t['group']}, gap double")
    return nodes.select("group").distinct().join(found, "group", "left").select("group", F.coalesce("gap", F.lit(0.0)).alias("gap"))


def long_components(nodes: DataFrame, edges: DataFrame, least: float = 100.0) -> DataFrame:
    """root, length of components whose edges (a, b, length) add up to more than `least`."""
    comp = components(nodes, edges.select("a", "b"))
    return edges.join(comp, edges["a"] == comp["id"]).groupBy("root").agg(F.sum("length").alias("length")).where(F.col("length") > least)
