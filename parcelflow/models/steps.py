"""Model steps: analyse assets, segment images, map types to labels. Answers are joined back by key, never by position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import attrs as A
from parcelflow.functions import text as X
from parcelflow.models.base import Backend, infer
from parcelflow.session import cut


def asset_images(assets: DataFrame, images: DataFrame) -> DataFrame:
    """id, paths of assets that have an image, paths in order."""
    i = images.groupBy("asset_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "path"))), lambda e: e["path"]).alias("paths"))
    return assets.select("id").join(i.withColumnRenamed("asset_id", "id"), "id")


def analyse(assets: DataFrame, images: DataFrame, backend: Callable[[], Backend], prompt: str, prefix: str = "model", most_images: int | None = None, batch: int = 4) -> DataFrame:
    """Assets with `prefix_key` attributes of the parsed answer (or `prefix_analysis_raw` where nothing could be parsed), the model's name and the number of images. The answers are written once, so that no later action asks the model again."""
    todo = asset_images(assets, images)
    got = cut(infer(todo, backend, prompt, images="paths", most_images=most_images, batch=batch))
    name = backend().name
    parsed = X.parse_answer(F.col("text"))
    raw = F.map_from_arrays(F.array(F.lit(f"{prefix}_analysis_raw")), F.array(F.col("text").cast("variant")))
    n = F.least(F.size("paths"), F.lit(most_images)) if most_images else F.size("paths")
    extra = F.map_from_arrays(F.array(F.lit("ai_model_used"), F.lit("images_analyzed_count")), F.array(F.lit(name).cast("variant"), n.cast("variant")))
    new = got.join(todo, "id").where("status = 'ok'").select("id", F.map_concat(F.when(F.size(parsed) > 0, X.prefixed(parsed, prefix)).otherwise(raw), extra).alias("__new"))
    old = F.col("attrs")
    return assets.join(new, "id", "left").withColumn("attrs", F.when(F.col("__new").isNull(), old).otherwise(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(F.col("__new"), k)), F.col("__new")))).select(*assets.columns)


def segment(assets: DataFrame, images: DataFrame, backend: Callable[[], Backend], prompts: list[str] | str, batch: int = 4) -> DataFrame:
    """asset_id, image_id, box, n: the boxes that the model finds on each image of the assets."""
    prompt = prompts if isinstance(prompts, str) else ". ".join(prompts)
    todo = images.join(assets.select(F.col("id").alias("asset_id")), "asset_id", "left_semi").select(F.to_json(F.struct("asset_id", "id")).alias("key"), F.array("path").alias("paths"))
    got = cut(infer(todo, backend, prompt, key="key", batch=batch)).where("status = 'ok'")
    k = F.from_json("key", "asset_id string, id string")
    return got.select(k.asset_id.alias("asset_id"), k.id.alias("image_id"), F.posexplode(F.from_json("boxes", "array<array<double>>")).alias("n", "box"))


def mask_rows(assets: DataFrame, images: DataFrame, backend: Callable[[], Backend], prompts: list[str] | str, batch: int = 4) -> DataFrame:
    """images with segment_boxes, segment_masks (as the model gives them) and ai_model_used among their properties, where the model answered. Answers are written once."""
    prompt = prompts if isinstance(prompts, str) else ". ".join(prompts)
    todo = images.join(assets.select(F.col("id").alias("asset_id")), "asset_id", "left_semi").select(F.to_json(F.struct("asset_id", "id")).alias("key"), F.array("path").alias("paths"))
    got = cut(infer(todo, backend, prompt, key="key", batch=batch)).where("status = 'ok'")
    k = F.from_json("key", "asset_id string, id string")
    found = F.map_from_arrays(F.array(*map(F.lit, ("segment_boxes", "segment_masks", "ai_model_used"))), F.array(F.parse_json("boxes"), F.parse_json("masks"), F.lit(backend().name).cast("variant")))
    new = got.select(k.asset_id.alias("asset_id"), k.id.cast(dict(images.dtypes)["id"]).alias("id"), found.alias("__new"))
    old = F.coalesce("props", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(F.col("__new"), k)), F.col("__new"))
    return images.join(new, ["asset_id", "id"], "left").withColumn("props", F.when(F.col("__new").isNull(), F.col("props")).otherwise(merged)).select(*images.columns)


def map_labels(assets: DataFrame, backend: Callable[[], Backend], prompt: str, valid: list[str]) -> DataFrame:
    """asset_type, labels of each type that assets have; failures give none."""
    types = assets.select(A.asset_type(F.col("attrs")).alias("asset_type")).where("asset_type is not null").distinct()
    got = infer(types.withColumn("paths", F.array("asset_type")), backend, prompt, key="asset_type")
    return got.select("asset_type", F.coalesce(X.labels_in(F.coalesce("text", F.lit("")), valid), F.array().cast("array<string>")).alias("labels"))
