"""Event time.  Nothing here depends on the session time zone but for display."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIRST_SECOND = -62135596800  # 0001-01-01T00:00:00Z
_LAST_SECOND = 253402300799  # 9999-12-31T23:59:59Z


def _usable(epoch: Column) -> Column:
    # A broken clock (infinite, beyond the calendar) becomes a null time: one bad message
    # must not overflow and fail the job.
    return F.when((epoch >= _FIRST_SECOND) & (epoch <= _LAST_SECOND), epoch)


def whole_second(epoch: Column) -> Column:
    """Epoch seconds (double) as a timestamp cut to the second."""
    return F.timestamp_seconds(F.floor(_usable(epoch)))


def exact_time(epoch: Column) -> Column:
    """Epoch seconds (double) as a timestamp, fraction kept."""
    return F.timestamp_seconds(_usable(epoch))


def utc_day(epoch: Column) -> Column:
    return F.date_from_unix_date(F.floor(_usable(epoch) / 86400).cast("int"))


def relative_age(moment: Column, as_of: Column) -> Column:
    """``Just now``, ``5 mins ago``, ``3 hours ago``, ``2 days ago`` or ``Unknown``."""
    micros = F.unix_micros(as_of) - F.unix_micros(moment)
    minute, hour, day = 60_000_000, 3_600_000_000, 86_400_000_000

    def ago(unit: int, name: str) -> Column:
        return F.concat(F.floor(micros / unit).cast("string"), F.lit(f" {name} ago"))

    return (
        F.when(moment.isNull(), "Unknown")
        .when(micros < minute, "Just now")
        .when(micros < hour, ago(minute, "mins"))
        .when(micros < day, ago(hour, "hours"))
        .otherwise(ago(day, "days"))
    )
