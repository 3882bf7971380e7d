"""Scalar column functions that operators and documents share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def run_stamp(at: Column) -> Column:
    """A UTC time as the name of a run: date, T, time to the microsecond, Z, without separators."""
    return F.date_format(at, "yyyyMMdd'T'HHmmssSSSSSS'Z'")


def iso_stamp(at: Column) -> Column:
    """A UTC time in ISO 8601 to the microsecond."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def below(base: Column, path: Column) -> Column:
    """A path that a document names: as it is if absolute, else beside the document; `.` and `..` steps are resolved."""
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path))
    step = lambda kept, part: F.when(part.isin("", "."), kept).when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step), "/"))


def space_id(room_id: Column, connector_id: Column) -> Column:
    """A plan space's id: the room's, or the connector's where that is missing or empty."""
    return F.coalesce(F.nullif(room_id, F.lit("")), connector_id)
