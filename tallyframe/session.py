"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(
    master: str | None = None,
    app: str = "tallyframe",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with UTC dates and adaptive execution. ``master`` is for local runs only."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str | None = None) -> str:
    """Folder every executor can reach: the one in ``spark.checkpoint.dir``.

    Only a local master may do without: a temporary folder is made there. On a cluster a folder of one machine
    would lose rows without a word, so a missing setting is an error. Tables of a session share one subfolder, which
    a retention rule can delete.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tallyframe-")
        spark.sparkContext.setCheckpointDir(root)
    if label is None:
        return root
    return f"{root.rstrip('/')}/tallyframe-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from the written table.

    The table outlives any executor, is computed once (a checkpoint would compute
    it twice), and its readers prune columns and know its size when they choose
    a join.
    """
    path = scratch_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
