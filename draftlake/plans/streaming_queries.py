"""Extension queries over the events stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from draftlake.common import table
from draftlake.streaming import events


def ext_event_windows(spark: SparkSession, d: str) -> DataFrame:
    return events.windowed_counts(table(spark, d, "events"))


def ext_event_windows_stream(spark: SparkSession, d: str) -> DataFrame:
    return events.drained(events.windowed_counts(events.event_stream(spark, d)), "ext_event_windows_stream")


_SQL = "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def queries() -> dict:
    return {f.__name__: f for f in (ext_event_windows, ext_event_windows_stream)}


def oracle_sql() -> dict[str, str]:
    return {"ext_event_windows": _SQL, "ext_event_windows_stream": _SQL}
