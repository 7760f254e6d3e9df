"""Heading paths: carried through blocks, and as-of joined to pages."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from citeloom import fixed
from citeloom.functions import text as tx


def _paths(conservative: bool):
    def run(headings: pd.Series) -> pd.Series:
        out = []
        for items in headings:
            path, seen = [], []
            for item in items if items is not None else ():
                level = item["level"]
                if conservative:
                    level = min(level, len(path) + 1)
                path = [*path[: level - 1], item["title"]]
                seen.append(path)
            out.append(seen)
        return pd.Series(out)

    return run


def heading_paths(headings: Column, *, conservative: bool) -> Column:
    """The path after each heading of an array of struct<level, title>.

    A heading of level L keeps the first L-1 parts of the path before it and
    adds itself; the conservative form never skips past depth + 1.
    """
    return F.pandas_udf(_paths(conservative), ArrayType(ArrayType(StringType())))(headings)


def carry_headings(blocks: DataFrame, key: str, *, conservative: bool = False) -> DataFrame:
    """Text blocks with the heading path in force.

    ``blocks``: key, block_no, level (NULL for text), text. Headings are few
    next to text, so only they are gathered per document to be folded; text
    blocks find theirs by a running maximum over the document.
    """
    title = tx.heading_title(F.col("text")) if conservative else F.col("text")
    headings = (
        blocks.where("level between 1 and 9")
        .withColumn("title", title)
        .where(F.length("title") > 0)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("block_no", "level", "title"))).alias("items"))
        .withColumn("paths", heading_paths(F.col("items"), conservative=conservative))
        .select(key, F.explode(F.arrays_zip("items", "paths")).alias("h"))
        .select(key, F.col("h.items.block_no").alias("block_no"), F.col("h.paths").alias("path"))
    )
    so_far = Window.partitionBy(key).orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocks.join(headings, [key, "block_no"], "left")
        .withColumn("path", F.last("path", ignorenulls=True).over(so_far))
        .where(F.col("level").isNull() & (F.length("text") > 0))
        .select(
            key,
            "block_no",
            "text",
            F.coalesce("path", F.array(F.lit(fixed.FALLBACK_HEADING))).alias("heading_path"),
        )
    )


def page_headings(pages: DataFrame, outline: DataFrame, key: str) -> DataFrame:
    """The heading path of each page: the latest outline entry at or before it.

    ``pages``: key, page. ``outline``: key, ordinal, level, title, page; bad
    levels, titles and pages are left out. A page with more than one entry
    falls back, but later pages still inherit its last entry.
    """
    last_page = pages.groupBy(key).agg(F.max("page").alias("page_count"))
    entries = (
        outline.withColumn("title", tx.heading_title(F.col("title")))
        .join(last_page, key)
        .where("level between 1 and 9 and page between 1 and page_count and title is not null")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("page", "ordinal", "level", "title"))).alias("items"))
        .withColumn("paths", heading_paths(F.col("items"), conservative=True))
        .select(key, F.explode(F.arrays_zip("items", "paths")).alias("e"))
        .groupBy(key, F.col("e.items.page").alias("page"))
        .agg(
            F.count("*").alias("entries"),
            F.max_by(F.col("e.paths"), F.col("e.items.ordinal")).alias("path"),
        )
    )
    so_far = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    fallback = F.array(F.lit(fixed.FALLBACK_HEADING))
    return (
        pages.select(key, "page")
        .join(entries, [key, "page"], "left")
        .withColumn("in_force", F.last("path", ignorenulls=True).over(so_far))
        .select(
            key,
            "page",
            F.coalesce(F.when(F.coalesce("entries", F.lit(0)) <= 1, F.col("in_force")), fallback).alias(
                "heading_path"
            ),
            (F.coalesce("entries", F.lit(0)) > 1).alias("ambiguous"),
        )
    )
