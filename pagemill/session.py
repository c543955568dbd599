"""A Spark session with the settings the jobs expect."""

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, **extra: str) -> SparkSession:
    """A session on this machine, for tests and measurements."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagemill")
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in extra.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
