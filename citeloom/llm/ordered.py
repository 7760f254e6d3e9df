"""Tables sorted over all tasks, for work that runs along an order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by ranges of ``by`` (nulls first) and sorted within each; a key with many rows spans several tasks.

    The last column is the task's number, which grows with the order.
    """
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
