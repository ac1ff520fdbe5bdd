"""Retention that frees space: whole date partitions of a table expire, are hidden at once and deleted a run later.

    <table>/event_date=D/...          the rows of a day
    <table>.tombstones/<date>         days that were hidden on that date

A run first deletes the folders of days hidden by earlier runs, then hides the days that have expired since. A reader that
listed its files before a day was hidden has until the next run to finish. Runs may be repeated and may stop anywhere: a
tombstone is one small file, written before anything is deleted, and a folder that is gone already is no error.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablens.session import read_text, remove_path, write_text
from fablens.streaming.key_index import names_in

DAY = "event_date"


def _days(spark: SparkSession, path: str) -> list[dt.date]:
    names = [n.removeprefix(f"{DAY}=") for n in names_in(spark, path) if n.startswith(f"{DAY}=")]
    return sorted(dt.date.fromisoformat(n) for n in names if n != "__HIVE_DEFAULT_PARTITION__")


def _hidden(spark: SparkSession, path: str) -> dict[str, list[dt.date]]:
    """Days by the tombstone that hides them. A tombstone that was not written to its end hides nothing."""
    found = {}
    for name in sorted(names_in(spark, f"{path}.tombstones")):
        text = read_text(spark, f"{path}.tombstones/{name}") if not name.startswith(".") else None
        if text and text.endswith("]"):
            found[name] = [dt.date.fromisoformat(day) for day in json.loads(text)]
    return found


def drop_expired(spark: SparkSession, path: str, as_of: dt.date, days: int) -> dict[str, list[dt.date]]:
    """Hide the days before `as_of` - `days` and delete those hidden by earlier runs; returns both, as hidden and deleted."""
    earlier = {name: gone for name, gone in _hidden(spark, path).items() if name < as_of.isoformat()}
    there = set(_days(spark, path))
    deleted = sorted({day for gone in earlier.values() for day in gone} & there)
    for day in deleted:
        remove_path(spark, f"{path}/{DAY}={day}")
    hidden = [day for day in sorted(there - set(deleted)) if day < as_of - dt.timedelta(days=days)]
    if hidden:
        write_text(spark, f"{path}.tombstones/{as_of.isoformat()}", json.dumps([day.isoformat() for day in hidden]))
    for name, gone in earlier.items():
        if not set(gone) & (there - set(deleted)):
            remove_path(spark, f"{path}.tombstones/{name}")
    return {"hidden": hidden, "deleted": deleted}


def read_retained(spark: SparkSession, path: str) -> DataFrame:
    """The table without hidden days; their folders are not listed in the plan."""
    rows = spark.read.parquet(path)
    gone = sorted({day for days in _hidden(spark, path).values() for day in days})
    return rows.filter(~F.col(DAY).isin(gone)) if gone else rows
