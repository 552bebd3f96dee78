"""Small telemetry frames."""

from datetime import datetime, timedelta

START = datetime(2020, 1, 1)
EPOCH = datetime(1970, 1, 1)
SEC = 1_000_000
MIN = 60 * SEC


def micro(t: datetime) -> int:
    return round((t - EPOCH) / timedelta(microseconds=1))


T0 = micro(START)


def frame(spark, rows, schema):
    """rows: (seconds from START, values...); schema of the values."""
    return spark.createDataFrame([("A", T0 + round(s * SEC), *v) for s, *v in rows], f"asset_id string, us long, {schema}")


def column(df, name):
    return [r[name] for r in df.orderBy("us").select(name).collect()]
