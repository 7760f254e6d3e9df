"""Tables written between the jobs of one operator.

They cut lineage: a lost executor costs the tasks of the running job, not the
rounds before it. They go to the folder of ``spark.checkpoint.dir``.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from citeloom.session import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs run inside go when each job ends.

    Every job here ends in a written table, so nothing rereads its shuffles.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame over the files."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{name}")
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with short_lived_shuffles(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Remove the files of a table made by :func:`written` that nothing reads any more."""
    jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
    conf = session.sessionState().newHadoopConf()
    folders = {name.rsplit("/", 1)[0] for name in table.inputFiles()}
    for folder in folders:
        if "/llm-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, lengthened until none equals one of ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
