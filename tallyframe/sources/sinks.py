"""Report sinks: every table of a study under one folder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

FORMATS = ("parquet", "csv", "json")


def write_reports(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """Write each named table to its own folder, replacing an earlier report of the same name."""
    if fmt not in FORMATS:
        raise ValueError(f"report format must be one of {FORMATS}")
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{root.rstrip('/')}/{name}")
