"""Sessions: what the engine needs of one."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as the session names it. Where it names none, a local session, as in tests, gets a temporary folder; any other is an error, as no folder of one machine serves a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks(df: DataFrame) -> int:
    """Into how many tasks work in Python is split: a few for each core."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are tasks. A table of one file, or a join that adaptive execution put together, has few, by its bytes and not by the work on them. What was spread stays as it is."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "MapInArrow", "PythonMapInArrow", "MapInPandas"):
        plan = plan.children().head()
    return df if plan.nodeName() == "Repartition" else df.repartition(tasks(df))


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once an application, so that kernels can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="parcelflow-")) / "parcelflow.zip"  # the driver serves it to the workers
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
