"""Line dedup by overlapping three-line windows.

Every run of ``WINDOW`` consecutive lines is hashed. A window that occurs anywhere else keeps its first
occurrence (by doc_id, then line); the lines that later occurrences cover, merged per document, are
removed. Where a later occurrence overlaps the first one in the same document, the lines of the first stay.

Defined results: null ids come last in the order of occurrences; null texts stay null; texts with fewer
lines than a window are kept as they are; rows that repeat with id and text are one
occurrence and treated alike; rows with one id and other texts are documents of their own; all columns of
``docs`` are returned, but for those that have the names of the new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WINDOW = 3
#: A window that occurs more often is dealt out in parts of about so many; tables of such windows up to so many rows
#: are sent to all tasks.
PART_ROWS, BROADCAST_ROWS = 1000, 200_000
#: Lines are joined by this for hashing; it occurs in no line.
JOINT = "\n"


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the text changed, and the columns lines_before and lines_removed."""
    names = [c for c in docs.columns if c not in ("lines_before", "lines_removed")]
    # a document is its id and its text; equal rows are told apart by their order within that
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("line")).where(F.size("line") >= window)
    starts = F.sequence(F.lit(0), F.size("line") - window)
    windows = lines.select("doc_id", "text_hash", F.posexplode(F.transform(starts, lambda i: F.unhex(F.sha2(F.array_join(F.slice(F.col("line"), i + 1, window), JOINT), 256)))).alias("at", "window"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_hash"), F.col("at"))
    repeated = stored(windows.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "windows")
    often = repeated.where(F.col("n") > PART_ROWS).select("window", F.ceil(F.col("n") / PART_ROWS).alias("parts"))
    often = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    spread = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = windows.join(often, "window", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash", "at"), spread)).drop("parts")
    firsts = repeated.select("window", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.greatest(F.lit(1), F.when(F.col("n") > PART_ROWS, F.col("n")).otherwise(1) / PART_ROWS)) - 1)).alias("part"))
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = dealt.join(firsts, ["window", "part"]).where(~(here & (F.col("at") == F.col("first.at"))))
    low = F.when(here, F.greatest(F.col("at"), F.col("first.at") + window)).otherwise(F.col("at"))
    spots = later.select("doc_id", "text_hash", low.alias("low"), (F.col("at") + window - 1).alias("high")).where("low <= high")
    # merge touching spots of a document to runs
    order = Window.partitionBy("doc_id", "text_hash").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        spots.withColumn("fresh", F.when(F.col("low") <= reach + 1, 0).otherwise(1))
        .withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "text_hash", "run")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )
    covered = runs.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.collect_list(F.struct("low", "high")).alias("_gone"), F.sum(F.col("high") - F.col("low") + 1).alias("_removed")
    )
    # the row travels whole, so that its columns may have any names
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("row_hash"))
    joined = keyed.join(covered, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash")), "left")
    text = F.col("row.text")
    line = F.split(text, "\n")
    gone = F.flatten(F.transform("_gone", lambda run: F.sequence(run["low"], run["high"])))
    kept = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), gone)
    # the one-element array names the lines, so that the text is split once
    left = F.element_at(F.transform(F.array(line), lambda lines: F.array_join(F.transform(kept, lambda i: lines[i]), "\n")), 1)
    return joined.select(
        *[(F.when(F.col("_gone").isNull(), text).otherwise(left) if c == "text" else F.col("row")[c]).alias(c) for c in names],
        F.coalesce(F.size(line), F.lit(0)).cast("long").alias("lines_before"),
        F.coalesce("_removed", F.lit(0)).cast("long").alias("lines_removed"),
    )


def oracle() -> str:
    """DuckDB SQL for ``dedup_lines`` over ``documents``, on the lines themselves."""
    return f"""
with d as (select doc_id, text, string_split(text, chr(10)) as l from documents),
w as (select doc_id, unnest(range(0, len(l) - {WINDOW - 1})) as a, l from d where len(l) >= {WINDOW}),
win as (select doc_id, a, array_to_string(l[a + 1:a + {WINDOW}], chr(10)) as win_text from w),
rep as (select win_text, min(row(doc_id, a)) as f, count(*) as n from win group by win_text having count(*) > 1),
later as (select doc_id, case when doc_id = f[1] then greatest(a, f[2] + {WINDOW}) else a end as low, a + {WINDOW - 1} as high from win join rep using (win_text) where row(doc_id, a) <> f),
gone as (select doc_id, list(distinct i) as g from (select doc_id, unnest(range(low, high + 1)) as i from later where low <= high) group by doc_id)
select doc_id, case when g is null then text else array_to_string([l[i + 1] for i in range(0, len(l)) if not list_contains(g, i)], chr(10)) end as text,
  coalesce(len(l), 0)::bigint as lines_before, coalesce(len(g), 0)::bigint as lines_removed from d left join gone using (doc_id)
"""
