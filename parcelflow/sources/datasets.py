"""Named datasets: the caller's registry of files, fetched by the workers to a shared folder."""

from __future__ import annotations

import difflib
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from parcelflow.models.base import with_retry
from parcelflow.sources.imagery import Fetch
from parcelflow.sources.pictures import save

#: name -> {file name: address}
Registry = dict[str, dict[str, str]]


def names_of(registry: Registry, names: str | list[str] | None = None) -> list[str]:
    """The registry's names that are asked for, each once and in order; all without a wish. Case and blanks around don't matter. ValueError for others, with what may have been meant."""
    own = {n.strip().lower(): n for n in registry}
    out: dict[str, None] = {}
    for n in [names] if isinstance(names, str) else list(registry) if names is None else names:
        key = n.strip().lower()
        if key not in own:
            like = difflib.get_close_matches(key, own, 1, 0.5)
            raise ValueError(f"no dataset {n!r}" + (f"; did you mean {own[like[0]]!r}?" if like else f"; there are {', '.join(registry)}"))
        out[own[key]] = None
    return list(out)


def download(spark: SparkSession, registry: Registry, names: str | list[str] | None, folder: str, fetch: Fetch, overwrite: bool = False, partitions: int = 4, tries: int = 5) -> DataFrame:
    """dataset, path, status (saved, kept, failed), error of every file of the named datasets, at folder/dataset/file. Files that are there and not empty are kept. A row runs when it is read."""
    rows = [(n, f"{folder}/{n}/{f}", url) for n in names_of(registry, names) for f, url in registry[n].items()]

    def run(it):
        for pdf in it:
            out = []
            for n, p, u in pdf[["dataset", "path", "url"]].itertuples(index=False):
                try:
                    have = not overwrite and os.path.isfile(p) and os.path.getsize(p) > 0
                    if not have:
                        save(p, with_retry(lambda u=u: fetch(u), tries))
                    out.append((n, p, "kept" if have else "saved", None))
                except Exception as e:  # noqa: BLE001 - a file's failure is its result
                    out.append((n, p, "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["dataset", "path", "status", "error"])

    asked = spark.createDataFrame(rows, "dataset string, path string, url string")
    return asked.repartition(partitions).mapInPandas(run, "dataset string, path string, status string, error string")
