"""Past values on an hourly grid, without one join per offset.

Time is cut into blocks, and the tail of a block is copied into the next one
as history. Work is then spread by (series, block): a long or lone series is
still many bounded groups, and one shuffle serves any number of offsets.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadgrid.functions.temporal import epoch_hour

BLOCK = "_block"
DAY = 24
MIN_BLOCK_HOURS = 24 * 56


def block_hours(reach: int) -> int:
    """Length of a block that looks back ``reach`` hours: history is at most a
    quarter of it."""
    return max(MIN_BLOCK_HOURS, 4 * reach)


def block_of(hour: Column, length: int) -> Column:
    """The first hour of the block that holds ``hour``."""
    return hour - F.pmod(hour, F.lit(length))


def _with_history(hourly: DataFrame, time_col: str, reach: int) -> DataFrame:
    """Each row in its own block, and in the next if that looks back to it."""
    length = block_hours(reach)
    hour = F.col("_hour")
    blocks = F.sequence(
        block_of(hour, length), block_of(hour + reach, length), F.lit(length).cast("bigint")
    )
    return hourly.withColumn("_hour", epoch_hour(F.col(time_col))).withColumn(BLOCK, F.explode(blocks))


def over_hours(
    hourly: DataFrame,
    series: tuple[str, ...],
    columns: Mapping[str, tuple[Column, int, int]],
    time_col: str = "target_hour",
) -> DataFrame:
    """Add aggregates over hour ranges behind each row.

    ``columns`` maps a name to ``(aggregate, oldest, newest)``: the aggregate
    over the rows of the same series between ``oldest`` and ``newest`` hours
    before this one. Frames are ranges of time, not row counts, so an hour
    missing from the series is simply absent and never shifts its neighbours.
    """
    reach = max(oldest for _, oldest, _ in columns.values())
    w = Window.partitionBy(*series, BLOCK).orderBy("_hour")
    framed = {
        name: agg.over(w.rangeBetween(-oldest, -newest))
        for name, (agg, oldest, newest) in columns.items()
    }
    own = F.col(BLOCK) == block_of(F.col("_hour"), block_hours(reach))
    rows = _with_history(hourly, time_col, reach).withColumns(framed)
    return rows.where(own).drop("_hour", BLOCK)


@dataclass(frozen=True)
class DayBlocks:
    """Past values by (series, block): ``table`` has one row for each, with the
    days that hold values and, per day, the values of its hours."""

    table: DataFrame
    series: tuple[str, ...]
    days: int

    @property
    def keys(self) -> list[str]:
        return [*self.series, BLOCK]

    def value(self, hour: Column) -> Column:
        """The value at an hour, null where there is none, from the row of the
        block it is read from."""
        at = F.array_position(F.col("_days"), F.floor(hour / DAY))
        return F.when(at > 0, F.get(F.get("_values", (at - 1).cast("int")), F.pmod(hour, F.lit(DAY)).cast("int")))

    def hours(self) -> DataFrame:
        """One row per hour of a series that has a value, with its block's arrays."""
        own = F.col("_day").between(F.col(BLOCK), F.col(BLOCK) + self.days - 1)
        kept = [*self.keys, "_days", "_values"]
        days = self.table.select(*kept, F.posexplode("_days").alias("_at", "_day")).where(own)
        hours = days.select(*kept, "_day", F.posexplode(F.get("_values", F.col("_at"))).alias("_of_day", "_value"))
        return hours.where(F.col("_value").isNotNull()).select(*kept, (F.col("_day") * DAY + F.col("_of_day")).alias("_hour"))


def day_blocks(
    hourly: DataFrame, series: tuple[str, ...], value: str, back: int, ahead: int = 0, time_col: str = "target_hour"
) -> DayBlocks:
    """The hourly values from which any hour of a block can read those up to
    ``back`` hours before it, and ``ahead`` after it, by their distance.

    Hours are gathered to days and days to blocks in one shuffle of the narrow
    hourly rows; the neighbouring days that a block reads from are copied into
    it. Days without values take no room, so a group holds at most the block's
    and its history's days that the series has.
    """
    behind, beyond = -(-back // DAY), -(-ahead // DAY)
    length = max(MIN_BLOCK_HOURS // DAY, 4 * (behind + beyond))
    partitions = int(hourly.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hour = epoch_hour(F.col(time_col))
    day = F.floor(hour / DAY)
    blocks = F.sequence(block_of(day - beyond, length), block_of(day + behind, length), F.lit(length).cast("bigint"))
    keys = [*series, BLOCK]
    spread = hourly.select(
        *series, day.alias("_day"), F.pmod(hour, F.lit(DAY)).alias("_of_day"), F.col(value).alias("_value"), F.explode(blocks).alias(BLOCK)
    ).repartition(partitions, *keys)
    hours = F.array(*[F.max(F.when(F.col("_of_day") == h, F.col("_value"))) for h in range(DAY)])
    days = spread.groupBy(*keys, "_day").agg(hours.alias("_values"))
    gathered = days.groupBy(*keys).agg(F.collect_list(F.struct("_day", "_values")).alias("_found"))
    found = lambda name: F.transform("_found", lambda d: d[name]).alias(f"{name}s" if name == "_day" else name)
    return DayBlocks(gathered.select(*keys, found("_day"), found("_values")), series, length)
