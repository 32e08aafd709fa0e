"""Where results go: event and label tables, configurations, tables that grow run by run, and steps written on the way."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that only the analysis needs; they aren't part of an event table.
CONTEXT_COLUMNS = ("prev_template", "next_template", "prev_anomaly", "gap_prev_s", "gap_next_s")
_LOCAL: list[str] = []
#: Paths given out by :func:`scratch` and not deleted yet.
_WRITTEN: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Only a session on one machine may leave the folder unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "").rstrip("/")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="chronoloom-events-"))
        folder = _LOCAL[0]
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back.

    What several later steps use is worked out once, and lost executors cost nothing.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_stages(spark: SparkSession) -> None:
    """Delete all that :func:`scratch` and :func:`stage` have made: for the end of a job, as results are lazy and read such files."""
    for path in list(_WRITTEN):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _WRITTEN.discard(path)


def together(*calls: Callable, at_once: int = 4) -> list:
    """What the calls return.  They don't need each other, so their jobs, most of them small, run side by side."""
    inherit = inheritable_thread_target(SparkSession.active())  # the caller's job group and tags
    with ThreadPoolExecutor(max(1, min(at_once, len(calls)))) as pool:
        return [f.result() for f in [pool.submit(inherit(c)) for c in calls]]


def write_events(events: DataFrame, path: str, *, mode: str = "error", files_by_node: int | None = None) -> None:
    """An event table (clean or injected) as Parquet, without the context columns.

    ``files_by_node``: rows of a node lie together in one of so many files, sorted
    by time, so that readers of few nodes skip the rest.
    """
    rows = events.drop(*CONTEXT_COLUMNS)
    if files_by_node:
        rows = rows.repartition(files_by_node, "node").sortWithinPartitions("node", "timestamp", "row_id")
    rows.write.mode(mode).parquet(path)


def bucketed_events(events: DataFrame, table: str, path: str, *, buckets: int | None = None) -> DataFrame:
    """An event table of files bucketed by node and sorted by node and time, registered as ``table``; it is returned as read again.

    One shuffle here saves one in every later step by node: context, windows and
    joins on ``node`` read a bucket a task.  ``buckets`` (the session's
    shuffle partitions unless given) is the parallelism of those steps.
    """
    spark = events.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = events.drop(*CONTEXT_COLUMNS).repartition(buckets, "node")
    rows.write.bucketBy(buckets, "node").sortBy("node", "timestamp", "row_id").option("path", path).mode("overwrite").saveAsTable(table)
    return spark.table(table)


def write_table(rows: DataFrame, path: str, *, mode: str = "error") -> None:
    """A small result table (labels, cells, figures) as one CSV file with a header; times are ISO with microseconds."""
    rows.coalesce(1).write.mode(mode).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table written by :func:`write_table`."""
    return spark.read.schema(schema).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def write_config(config: DataFrame, path: str, *, mode: str = "error") -> dict:
    """A one-row configuration as one JSON file; it is returned, too."""
    config.coalesce(1).write.mode(mode).json(path)
    return json.loads(config.toJSON().first())


def write_injection(moved: DataFrame, labels: DataFrame, labelled: DataFrame, config: DataFrame, folder: str, *, mode: str = "error") -> None:
    """All artefacts of one injection run: events, labels, labelled cells and configuration."""
    write_events(moved, f"{folder}/events", mode=mode)
    write_table(labels, f"{folder}/labels", mode=mode)
    write_table(labelled, f"{folder}/grid_labels", mode=mode)
    write_config(config, f"{folder}/config", mode=mode)


# --- sweeps: a table of runs, each published whole or not at all -----------------------


def _marker(path: str, run: dict) -> str:
    """The file whose existence publishes a run."""
    return f"{path}/runs/{hashlib.sha256(json.dumps(run, sort_keys=True).encode()).hexdigest()[:32]}.json"


def _hadoop(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def published(spark: SparkSession, path: str) -> list[dict]:
    """[{run, folder}] of the runs of a sweep that are whole, in order of publication marks' names."""
    fs, folder = _hadoop(spark, f"{path}/runs")
    if not fs.exists(folder) or not len(fs.listStatus(folder)):
        return []
    lines = spark.read.text(f"{path}/runs").where("value <> ''").collect()  # a line a run
    return sorted((json.loads(r["value"]) for r in lines), key=lambda m: json.dumps(m["run"], sort_keys=True))


def publish_run(results: DataFrame, path: str, run: dict) -> bool:
    """Write one run's results aside, then publish them by one mark; False if someone else's are published already.

    A writer that fails leaves an unmarked folder that nobody reads, and of two
    writers of one run the second's rows are never seen.
    """
    spark = results.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    results.withColumns({k: F.lit(v) for k, v in run.items()}).write.parquet(f"{path}/{folder}")
    fs, marker = _hadoop(spark, _marker(path, run))
    if fs.exists(marker) and fs.getFileStatus(marker).getLen():
        return False
    if fs.exists(marker):  # its writer ended between making and filling it
        fs.delete(marker, False)
    try:
        out = fs.create(marker, False)  # fails if it has come to exist meanwhile
    except Py4JJavaError:
        return False
    try:
        out.write(bytearray(json.dumps({"run": run, "folder": folder}).encode() + b"\n"))
    finally:
        out.close()
    return True


def read_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """All published runs as one table; None if there are none."""
    folders = [f"{path}/{m['folder']}" for m in published(spark, path)]
    return spark.read.parquet(*folders) if folders else None


def sweep(spark: SparkSession, path: str, runs: list[dict], compute: Callable[..., DataFrame], *, at_once: int = 1) -> DataFrame:
    """The table of ``compute(**run)`` for all ``runs``, of which those published at ``path`` aren't worked out again.

    A sweep that is stopped goes on where it was, from any session.  Up to ``at_once`` runs go side by side.
    """
    done = [m["run"] for m in published(spark, path)]
    publish = lambda run: publish_run(compute(**run), path, run)
    together(*[partial(publish, run) for run in runs if run not in done], at_once=at_once)
    wanted = [f"{path}/{m['folder']}" for m in published(spark, path) if m["run"] in runs]
    return spark.read.parquet(*wanted)
