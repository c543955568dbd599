"""Tables of one run in the shared folder of the cluster."""

from pyspark.sql import DataFrame, SparkSession

from pagemill.sources import storage


class Scratch:
    """Writes a table once and reads it back, which cuts lineage and survives lost executors.

    Its stored size tells the planner whether it may be broadcast.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, storage.shared_dir(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            storage.delete(self.spark, f"{self.root}/{name}")
