"""Assembly of chat turns into message lists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _json(value: Column) -> Column:
    """JSON that keeps what is NULL."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def message_table(turns: DataFrame) -> DataFrame:
    """One ``{role, content}`` message per turn; (conv_id, turn) is the order.

    For conversations that are too long for one row.
    """
    message = F.struct("role", F.col("text").alias("content"))
    return turns.select("conv_id", "turn", _json(message).alias("message"))


def assemble_chat(turns: DataFrame) -> DataFrame:
    """The whole ordered list of ``{role, content}`` messages, one row per conversation."""
    message = F.struct("turn", "role", F.col("text").alias("content"))
    ordered = F.array_sort(F.collect_list(message))
    untimed = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    assembled = turns.groupBy("conv_id").agg(ordered.alias("messages"))
    return assembled.select("conv_id", F.size("messages").alias("n_messages"), _json(untimed).alias("messages"))
