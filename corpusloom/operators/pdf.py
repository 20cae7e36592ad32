"""Text of paged documents from positioned blocks: repeated lines, layout, reading order, clean-up.

A block table has doc, page, width, block_seq, x0, y0, x1, text and block_type (0 is text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: A line is a header or footer on that share of the pages, and on 3 at least.
SHARE, LEAST = 0.30, 3


def page_lines(pages: DataFrame) -> DataFrame:
    """doc, page, seq, line (stripped, not empty) from doc, page, text."""
    return pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("seq", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")


def repeated_lines(lines: DataFrame, pages: DataFrame, share: float = SHARE) -> DataFrame:
    """doc, line, pages of lines on many pages of their document. ``pages`` (doc, page) has blank ones too."""
    total = pages.select("doc", "page").distinct().groupBy("doc").agg(F.count("*").alias("n_pages")).where(f"n_pages >= {LEAST}")
    counts = lines.where(F.length("line") > 2).select("doc", "page", "line").distinct().groupBy("doc", "line").agg(F.count("*").alias("pages"))
    enough = F.col("pages") >= F.greatest(F.lit(LEAST), F.floor(F.col("n_pages") * F.lit(share)))
    return counts.join(total, "doc").where(enough).select("doc", "line", "pages")


def cleaned(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """Lines without repeated ones and lone page numbers."""
    return lines.join(repeated.select("doc", "line"), ["doc", "line"], "left_anti").where(~F.col("line").rlike(r"(?U)^\d{1,4}$"))


def text_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("block_type") == 0) & (strip(F.col("text")) != ""))


def layouts(blocks: DataFrame) -> DataFrame:
    """doc, page, layout: 'multi' if at least two blocks stand clearly on either side of the centre."""
    centre = F.col("width") / 2
    sides = text_blocks(blocks).groupBy("doc", "page").agg(F.count("*").alias("n"), F.count_if(F.col("x1") < centre * 0.85).alias("left"), F.count_if(F.col("x0") > centre * 1.15).alias("right"))
    return sides.select("doc", "page", F.when((F.col("n") >= 4) & (F.col("left") > 1) & (F.col("right") > 1), "multi").otherwise("single").alias("layout"))


def in_reading_order(blocks: DataFrame) -> DataFrame:
    """doc, page, text: the blocks of a page in order, joined by line feeds. Columns one after the other."""
    right = ((F.col("x0") + F.col("x1")) / 2 >= F.col("width") / 2).cast("int")
    multi = F.col("layout") == "multi"
    key = F.struct(F.when(multi, right).otherwise(0).alias("side"), F.col("y0"), F.when(multi, F.lit(0.0)).otherwise(F.col("x0")).alias("x"), F.col("block_seq"), F.col("text"))
    placed = text_blocks(blocks).join(layouts(blocks), ["doc", "page"])
    return placed.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda b: b["text"]), "\n").alias("text"))


def documents(blocks: DataFrame) -> DataFrame:
    """doc, num_pages, raw_text: cleaned pages joined by blank lines, blank pages left out."""
    pages = in_reading_order(blocks)
    lines = page_lines(pages)
    kept = cleaned(lines, repeated_lines(lines, blocks)).groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("text"))
    texts = kept.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("raw_text"))
    total = blocks.groupBy("doc").agg(F.count_distinct("page").alias("num_pages"))
    return total.join(texts, "doc", "left").select("doc", "num_pages", F.coalesce("raw_text", F.lit("")).alias("raw_text"))
