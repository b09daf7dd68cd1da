"""Writers. CSV files have a header, doubled quotes and, by default, a byte-order mark."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame

from corpusloom.operators.split import train_val

log = logging.getLogger(__name__)


MARK = "\ufeff"


def _csv(df: DataFrame, path: str, mark: bool) -> None:
    if mark:  # it stands before the first name of every file's header
        df = df.withColumnRenamed(df.columns[0], MARK + df.columns[0])
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # outer blanks are part of a text
    df.write.mode("overwrite").options(header=True, escape='"', emptyValue='""', **blanks).csv(path)


def write_csv(df: DataFrame, path: str, backup: str | None = None, mark: bool = True) -> None:
    """Also to ``backup``; a failure there is only logged."""
    _csv(df, path, mark)
    if backup:
        try:
            _csv(df, backup, mark)
        except Exception as e:  # noqa: BLE001
            log.warning("backup to %s failed: %s", backup, e)


def write_splits(cleaned: DataFrame, folder: str, key: str = "id", share: float = 0.15, seed: int = 42, backup: str | None = None) -> None:
    """The whole set and its train and validation parts as three CSV folders, from one split of exact size. ``cleaned``
    is read several times: pass a table. Keys must be unique."""
    routed = train_val(cleaned, key, share, seed)
    parts = {"cleaned": cleaned, **{name: routed.filter(routed.split == name).drop("split") for name in ("train", "val")}}
    for name, part in parts.items():
        write_csv(part, f"{folder}/{name}", f"{backup}/{name}" if backup else None)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines (line_no, line) as one text file."""
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)
