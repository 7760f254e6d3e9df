"""Connected components of a table of links, by smallest labels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.written import written


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (a, b) with the smallest node it is connected to.

    Each turn takes the smallest label among a node and its neighbours and then
    that label's own label, so paths halve at least. Sums over neighbours are
    taken before rows move; a hub costs one row a task. A turn's labels are
    written, and the turns end when none changes.
    """
    both = written(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .distinct(),
        "links",
    )
    labels = written(
        both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "other"), "other")
            .groupBy("node")
            .agg(F.min("root").alias("near"))
        )
        lower = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jumped = lower.join(
            labels.select(F.col("node").alias("low"), F.col("root").alias("next")), "low", "left"
        ).select("node", F.coalesce(F.least("low", "next"), "low").alias("new"), "root")
        step = written(jumped, "labels")
        labels = step.select("node", F.col("new").alias("root"))
        if step.filter("new <> root").isEmpty():
            return labels
