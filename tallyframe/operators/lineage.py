"""File manifests, append-only records, dataset versions and run lineage as Parquet tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.operators.quality import table_fingerprint
from tallyframe.operators.skew import spread_work

VERSION_SCHEMA = (
    "id string, dataset_name string, version string, sha256 string, row_count long, schema_json string, "
    "source_uri string, as_of_date string, is_synthetic boolean, parent_version string, snapshot_path string, "
    "metadata_json string, created_at timestamp"
)
STORED_SCHEMA = VERSION_SCHEMA.replace("version string, sha256", "sha256")
RUN_SCHEMA = (
    "run_id string, election_id string, election_year int, as_of_date string, model_version string, "
    "input_versions map<string,string>, output_sha256 string, dataset_type string, publication_status string, "
    "created_at timestamp"
)


# Fixed value: largest page of run records.
LATEST_ROWS = 1000


# Files beyond this many bytes are hashed as a stream: a row of Spark holds at most 2 GB, and several copies of it.
ROW_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def file_manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """Path, size and SHA-256 of every file; files are hashed in parallel, one per row, large ones chunk by chunk."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    small = files.where(F.col("length") <= ROW_BYTES).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if files.where(F.col("length") > ROW_BYTES).select("path").isEmpty():
        return small
    return small.unionByName(_large_manifest(spark, paths))


def _large_manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Manifest of the files beyond ``ROW_BYTES``.

    Spark's readers give a file in pieces only as lines, so its splits are read as lines of bytes that end at 0x0A and are
    joined to chunks again; one task per file hashes its chunks in order and keeps none of them. The reader drops a byte order
    mark at the beginning and does not tell whether the last line has an end: the file's size tells both. A file
    whose bytes cannot be had like this (one that Spark unpacks by its name, say) is an error.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(list(paths))
    lines = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"),
    ).where(F.col("_metadata.file_size") > ROW_BYTES)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, held, size = None, 0, [], 0

        def chunk() -> pa.RecordBatch:
            path, whole, start = at
            return pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([whole], pa.int64()), pa.array([start], pa.int64()), pa.array([part], pa.int64()), pa.array([b"\n".join([*held, b""])], pa.binary())],
                names=["path", "bytes", "start", "part", "body"])

        for batch in batches:
            for *here, line in zip(*[c.to_pylist() for c in batch.columns]):
                if here != at or size >= CHUNK_BYTES:
                    if held:
                        yield chunk()
                    part = part + 1 if here == at else 0
                    at, held, size = here, [], 0
                held.append(line)
                size += len(line) + 1
        if held:
            yield chunk()

    def hashed(rows: Iterator) -> Iterator[tuple[str, int, str]]:
        path, whole, seen, tail, digests = None, 0, 0, b"", []

        def close() -> tuple[str, int, str]:
            # Every line was given an end; the last one may have none, and a mark may have been dropped.
            for digest, mark in zip(digests, (b"", BYTE_ORDER_MARK)):
                if whole - len(mark) in (seen, seen - 1):
                    digest.update(tail[: len(tail) + whole - len(mark) - seen])
                    return unquote(path), whole, digest.hexdigest()  # metadata has the path quoted
            raise ValueError(f"{path} has {whole} bytes, its lines {seen}")

        for r in rows:
            if r["path"] != path:
                if path is not None:
                    yield close()
                path, whole, seen, tail, digests = r["path"], r["bytes"], 0, b"", [hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK)]
            for digest in digests:
                digest.update(tail)
            tail = bytes(r["body"])
            seen += len(tail)
        if path is not None:
            yield close()

    parts = lines.mapInArrow(chunks, "path string, bytes long, start long, part long, body binary")
    placed = spread_work(parts, "path").sortWithinPartitions("path", "start", "part")
    # Rows go over one by one, as an Arrow batch would hold thousands of chunks.
    return spark.createDataFrame(placed.rdd.mapPartitions(hashed), "path string, bytes long, sha256 string")


def latest(df: DataFrame, order: Sequence[str], limit: int = 100) -> DataFrame:
    """Newest rows, at most ``LATEST_ROWS`` at a time; another limit is an error."""
    if not 1 <= int(limit) <= LATEST_ROWS:
        raise ValueError(f"limit must be between 1 and {LATEST_ROWS}: {limit}")
    return df.orderBy(*[F.desc(c) for c in order]).limit(int(limit))


def append_records(df: DataFrame, path: str, payload: Sequence[str], run_id: str = "run_id") -> None:
    """Append run records with the hash of their payload."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(payload)]))
    df.select(
        F.col(run_id).cast("string").alias("run_id"), F.current_timestamp().alias("created_at"),
        F.sha2(body, 256).alias("sha256"), body.alias("payload"),
    ).write.mode("append").json(path)


RECORD_SCHEMA = "run_id string, created_at timestamp, sha256 string, payload string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD_SCHEMA).json(path)


def find_record(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return read_records(spark, path).where(F.col("run_id") == run_id)


def number_versions(df: DataFrame, dataset: str, digest: str, created: str, bucket: Column) -> DataFrame:
    """``v%06d`` per dataset in order of first registration; equal content keeps its first version.

    First registrations are numbered within their ``bucket`` (a coarse time,
    monotone in ``created``); the bucket's offset is added from per-bucket counts.
    So even one dataset with most of the rows is numbered in parallel.
    """
    first = df.groupBy(dataset, digest).agg(F.min(created).alias(created)).withColumn("_bucket", bucket)
    per_bucket = first.groupBy(dataset, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(dataset).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(dataset, "_bucket").orderBy(created, digest))
    return first.withColumn("_local", local).join(offsets, [dataset, "_bucket"]).select(
        dataset, digest, created, F.format_string("v%06d", F.col("_offset") + F.col("_local")).alias("version")
    )


class Registry:
    """Dataset versions and prediction runs in append-only Parquet tables under one folder.

    A registration is appended with the hash of its content and without a number: versions are numbered, and
    registrations of known content left out, when the table is read, in order of time. Several writers need no lock.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, table: str, row: tuple, schema: str) -> None:
        """A record is a folder of its own, so writers share no temporary files."""
        self.spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{self.root}/{table}/{uuid.uuid4()}")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def list_versions(self, dataset: str | None = None) -> DataFrame:
        rows = self._read("dataset_versions", STORED_SCHEMA)
        if dataset is not None:
            rows = rows.where(F.col("dataset_name") == dataset)
        names = [c for c in rows.columns if c not in ("dataset_name", "sha256", "id", "created_at")]
        first = rows.groupBy("dataset_name", "sha256").agg(F.min_by(F.struct("id", *names), F.struct("created_at", "id")).alias("r"))
        numbers = number_versions(rows, "dataset_name", "sha256", "created_at", F.date_trunc("day", "created_at"))
        known = first.join(numbers, ["dataset_name", "sha256"]).select("dataset_name", "sha256", "r.*", "created_at", "version")
        return known.select(*[c.split()[0] for c in VERSION_SCHEMA.split(", ")]).orderBy(F.desc("created_at"), F.desc("version"))

    def register(
        self,
        name: str,
        df: DataFrame,
        as_of: str | None = None,
        source_uri: str | None = None,
        is_synthetic: bool = False,
        parent_version: str | None = None,
        metadata: dict | None = None,
    ) -> dict:
        """Version of this content: the known one, or the next one with a Parquet snapshot."""
        mark = table_fingerprint(df).first()
        same = F.col("sha256") == mark["fingerprint"]
        known = self.list_versions(name).where(same).first()
        if known is not None:
            return known.asDict()
        key = str(uuid.uuid4())
        path = f"{self.root}/snapshots/{name}/{mark['fingerprint'][:12]}-{key}"
        df.write.mode("errorifexists").parquet(path)
        schema = json.dumps({f.name: f.dataType.simpleString() for f in df.schema.fields}, sort_keys=True)
        self._append("dataset_versions", (
            key, name, mark["fingerprint"], mark["row_count"], schema, source_uri, as_of, is_synthetic, parent_version, path,
            json.dumps(metadata or {}, sort_keys=True), datetime.now(UTC).replace(tzinfo=None),
        ), STORED_SCHEMA)
        return self.list_versions(name).where(same).first().asDict()

    def record_run(
        self, election_id: str, election_year: int, as_of: str, model_version: str,
        input_versions: dict[str, str], output: DataFrame, dataset_type: str, publication_status: str,
    ) -> str:
        run_id = str(uuid.uuid4())
        digest = table_fingerprint(output).first()["fingerprint"]
        self._append("prediction_runs", (
            run_id, election_id, election_year, as_of, model_version, input_versions, digest, dataset_type,
            publication_status, datetime.now(UTC).replace(tzinfo=None),
        ), RUN_SCHEMA)
        return run_id

    def list_runs(self, limit: int = 100) -> DataFrame:
        return latest(self._read("prediction_runs", RUN_SCHEMA), ["created_at", "run_id"], limit)

    def get_run(self, run_id: str) -> DataFrame:
        return self._read("prediction_runs", RUN_SCHEMA).where(F.col("run_id") == run_id)
