"""What operators need to know of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that one task is to sort and group: what it holds doesn't grow with the table.
ROWS_A_TASK = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` or the session's own checkpoint folder. Without either, a session on
    one machine uses its warehouse; elsewhere nothing is known to be shared, and an error says so.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints").rstrip("/")


def cut_off(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder: its lineage ends there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def tasks_for(rows: DataFrame) -> int:
    """Into how many tasks to deal ``rows`` by a key; those of a file are counted by its footers.

    Adaptive execution joins shuffle partitions up to a number of compressed bytes, whatever the rows take
    when they are sorted and grouped; ``repartition`` to a number of its own keeps them apart.
    """
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))
