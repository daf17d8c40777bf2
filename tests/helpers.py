from datetime import UTC, datetime, timedelta

T0 = datetime(2026, 7, 6, tzinfo=UTC)  # a Monday


def at(hours=0.0, days=0, base=T0):
    return base + timedelta(days=days, hours=hours)


def epoch(when):
    return int(when.timestamp())


def hours_of(df, *columns):
    """Rows as tuples, times as epoch seconds."""
    from pyspark.sql import functions as F

    picked = [
        F.unix_seconds(c).alias(c) if dict(df.dtypes)[c] == "timestamp" else F.col(c)
        for c in columns or df.columns
    ]
    return sorted((tuple(r) for r in df.select(*picked).collect()), key=repr)


def own_cell(lat, lon, res=5):
    """Plain-Python twin of the grid."""
    step = 180.0 / (1 << (res + 5))
    rows = 1 << (res + 5)
    row = min(max(int((lat + 90.0) // step), 0), rows - 1)
    col = min(int(((lon + 180.0) % 360.0) // step), 2 * rows - 1)
    return (res << 52) | (row << 26) | col
