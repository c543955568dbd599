"""Events by day and kind, as a stream with late rows, and the same as a batch."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill.sources import storage

DELAY = "1 day"
MONITORED = "day date, event_type string, n long, total decimal(28,2), last timestamp"


def daily(events: DataFrame, delay: str | None = None) -> DataFrame:
    """(day, event_type, n, total, last) of events (ts, event_type, value) by day in the session's time zone.

    With ``delay`` a stream holds the state of a day until ``delay`` after its end, by
    the time of the events; a row that comes later is late and not counted.
    Totals are exact to the cent; NULL values count as rows; rows without time do not.
    """
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("decimal(18,2)").alias("value"))
    rows = rows.where("ts is not null")
    if delay:
        rows = rows.withWatermark("ts", delay)
    days = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    found = days.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("ts").alias("last"))
    return found.select(F.to_date("w.start").alias("day"), "event_type", "n", "total", "last")


class Monitor:
    """Daily figures under ``root``: each micro-batch writes the days it has changed as one load.

    A batch that is replayed replaces its own load.  Read, the newest load of a day counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def take(self, path: str, schema: StructType, files_per_batch: int = 10_000) -> int:
        """Count all events that landed in ``path`` since the last call; returns how many rows were late."""

        def store(days: DataFrame, batch: int) -> None:
            days.write.mode("overwrite").parquet(f"{self.root}/days/load={batch:012d}")

        landed = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        query = (
            daily(landed, DELAY)
            .writeStream.outputMode("update")
            .foreachBatch(store)
            .option("checkpointLocation", f"{self.root}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])

    def days(self) -> DataFrame:
        """(day, event_type, n, total, last) of all days so far."""
        if not storage.children(self.spark, f"{self.root}/days"):
            return self.spark.createDataFrame([], MONITORED)
        loads = self.spark.read.schema(f"{MONITORED}, load string").parquet(f"{self.root}/days")
        newest = loads.groupBy("day", "event_type").agg(F.max_by(F.struct("n", "total", "last"), "load").alias("newest"))
        return newest.select("day", "event_type", "newest.*")
