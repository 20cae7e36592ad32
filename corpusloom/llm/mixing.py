"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order weigh ``WEIGHTS`` in turn and share ``SHARE`` of all words; a target
stops at ``MOST`` times its source's words and the excess goes to the others by weight (water filling).
Rates: of all rates per document, up to ``MOST``, that meet the words of each source, those of least relative
entropy to taking every document once are ``min(MOST, exp(dual * size))``, with one dual value a source: long
documents are tilted up where a source has to grow, and down where it has to shrink. The dual is convex; damped
Newton steps inside a shrinking bracket find its values. Each step is one distributed sum over the (source,
size) histogram, in decimals, so that the order of the sum doesn't matter.
Copies: rates are rounded systematically along the documents of a source in order of size, so that every
stretch of sizes gets its share of copies; then a few documents of fitting sizes, at most one per
power of two and source, change by one copy to take up the rest.

Defined results: a null text has size 0; a null source is a source, the last; documents of size 0 have rate 1
and count nothing; rows that repeat are separate documents; no rows give no rows. Ties are ordered by a hash of
the id, then by id. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, stored

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Documents of one source and size are ranked in parts of about so many.
PART_ROWS = 256
#: Tables of sources, or of large (source, size) cells, up to so many rows are sent to all tasks.
BROADCAST_ROWS = 200_000
#: Sizes of a source are summed up in so many stretches for each doubling, then within them.
STRETCHES = 16
#: Newton stops at this relative distance from the targets; a step moves the rate of a mean document by e^2 at most.
CLOSE, MOST_STEPS, STEP = 1e-7, 80, 2.0
#: Rates are rounded in units of 2^-24.
UNIT = 1 << 24


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size, target from (source, source_size)."""
    everything = Window.partitionBy(F.lit(0))  # one row per source
    ranked = sources.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    cap = F.col("source_size") * MOST
    by_room = everything.orderBy((F.col("source_size") / F.col("weight")).asc(), "rank")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    place = F.row_number().over(by_room)
    ranked = ranked.withColumn("level", level).withColumn("place", place)
    fits = F.when(cap / F.col("weight") >= F.col("level"), F.struct("place", "level"))
    ranked = ranked.withColumn("water", F.min(fits).over(everything)["level"])
    return ranked.select("source", "source_size", F.coalesce(F.least(cap, F.col("weight") * F.col("water")), cap).alias("target"))


def _sent(wanted: DataFrame, each: int = 1) -> Callable[[DataFrame], DataFrame]:
    """How tables with ``each`` rows a source are joined: they are sent to all tasks if there are few sources."""
    return F.broadcast if wanted.count() * each <= BROADCAST_ROWS else lambda df: df


def balance(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """s, dual: the values whose rates meet the targets, from cells (s, size, n) and sources (s, target, source_size,
    mean, least). Sizes are taken in units of the source's mean."""
    grow, full = F.col("target") > F.col("source_size"), F.col("target") >= F.col("source_size") * (MOST * (1 - 1e-12))
    ratio = F.col("target") / F.col("source_size")
    # where all documents reach MOST, or where even the shortest ones have shrunk enough
    high = F.when(grow, F.log(F.lit(MOST)) * F.col("mean") / F.col("least") * 1.0001).otherwise(0.0)
    low = F.when(grow, F.lit(0.0)).otherwise(F.log(ratio) * F.col("mean") / F.col("least"))
    real, sent = wanted.where("target > 0"), _sent(wanted)
    duals = stored(real.select("s", "target", "mean", low.alias("low"), high.alias("high"), F.when(full, high).otherwise(0.0).alias("dual"), full.alias("done")), "duals")
    for _ in range(MOST_STEPS):
        r = rate(F.col("dual"), F.col("size"), F.col("mean"))
        words = F.col("n") * F.col("size") * r
        bend = F.when(r < MOST, words * F.col("size") / F.col("mean")).otherwise(0.0)
        own = ["s", "target", "mean", "low", "high", "dual", "done"]
        exact = lambda x: F.sum(x.cast("decimal(32,6)")).cast("double")
        tilted = cells.where("size > 0").join(sent(duals), "s").groupBy(*own).agg(exact(words).alias("mass"), exact(bend).alias("bend"))
        short = F.col("mass") < F.col("target")
        low, high = F.when(short, F.col("dual")).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(F.col("dual"))
        step = F.greatest(F.lit(-STEP), F.least(F.lit(STEP), (F.col("target") - F.col("mass")) / F.col("bend")))
        newton = F.when(F.col("bend") > 0, F.col("dual") + step)
        inside = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        done = F.col("done") | (F.abs(F.col("mass") - F.col("target")) <= CLOSE * F.col("target"))
        last, duals = duals, stored(tilted.select("s", "target", "mean", low.alias("low"), high.alias("high"), F.when(done, F.col("dual")).otherwise(inside).alias("dual"), done.alias("done")), "duals")
        discard(last)
        if duals.where("not done").isEmpty():
            break
    return duals.select("s", "dual")


def rate(dual: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(MOST), F.exp(F.least(F.lit(1.0), dual * size / mean)))


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, s (the source, never null), text_hash, size, nth: the number of a row among those of equal id,
    source and text, which are interchangeable."""
    rows = docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), n_words(F.col("text")).alias("size"), *more)
    same = Window.partitionBy("doc_id", "s", "text_hash", "size")
    return rows.withColumn("nth", F.row_number().over(same.orderBy("s")))


KEY = ["s", "text_hash", "size", "nth"]


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, nth (number among equal rows), source, size, source_size, target, rate, copies, taken."""
    rows = stored(keyed(docs), "sizes")
    cells = stored(rows.groupBy("s", "source", "size").agg(F.count("*").alias("n")), "cells")
    held = cells.groupBy("s", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    found = targets(held.select("source", "source_size")).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s"), "target")
    wanted = stored(held.join(found, "s").select("s", "source_size", "target", (F.col("source_size") / F.col("docs")).alias("mean"), "least"), "targets")
    sent = _sent(wanted)
    per_source = wanted.join(balance(cells.drop("source"), wanted), "s", "left").select("s", "source_size", "target", "mean", F.coalesce("dual", F.lit(0.0)).alias("dual"))
    per_cell = cells.join(sent(per_source), "s").withColumn("rate", F.when(F.col("size") > 0, rate(F.col("dual"), F.col("size"), F.col("mean"))).otherwise(F.lit(1.0)))
    per_cell = per_cell.withColumn("units", F.round(F.col("rate") * UNIT).cast("long")).withColumn("stretch", F.floor(F.log2(F.col("size") + 1) * STRETCHES))
    per_cell = stored(per_cell.select("s", "size", "n", "stretch", "source_size", "target", "rate", "units"), "rates")

    # what stands before each cell in the size order of its source: the stretches before, then the sizes before
    before = lambda w: F.coalesce(F.sum("sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = per_cell.groupBy("s", "stretch").agg(F.sum(F.col("n") * F.col("units")).alias("sum"))
    stretches = stretches.select("s", "stretch", before(Window.partitionBy("s").orderBy("stretch")).alias("base"))
    placed = per_cell.withColumn("sum", F.col("n") * F.col("units")).withColumn("within", before(Window.partitionBy("s", "stretch").orderBy("size")))
    placed = placed.join(_sent(wanted, 32 * STRETCHES)(stretches), ["s", "stretch"]).select("s", "size", "source_size", "target", "rate", "units", (F.col("base") + F.col("within")).alias("base"))

    # and before each document in its cell, large cells in parts
    big = cells.where(F.col("n") > PART_ROWS).select("s", "size", F.ceil(F.col("n") / PART_ROWS).alias("parts"))
    big = F.broadcast(big) if big.count() <= BROADCAST_ROWS else big
    dealt = rows.join(big, ["s", "size"], "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash", "nth"), F.coalesce("parts", F.lit(1).cast("long"))))
    counts = dealt.groupBy("s", "size", "part").agg(F.count("*").alias("n")).withColumn("sum", F.col("n")).withColumn("earlier", before(Window.partitionBy("s", "size").orderBy("part")))
    offsets = counts.join(placed, ["s", "size"]).select("s", "size", "part", "source_size", "target", "rate", "units", (F.col("base") + F.col("earlier") * F.col("units")).alias("base"))
    in_part = Window.partitionBy("s", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash", "nth")
    ranked = dealt.withColumn("place", F.row_number().over(in_part)).join(offsets, ["s", "size", "part"])
    upto = lambda k: F.floor((F.col("base") + k * F.col("units") + UNIT // 2) / UNIT)
    copies = upto(F.col("place")) - upto(F.col("place") - 1)
    rounded = stored(ranked.select("doc_id", *KEY, "source", "source_size", "target", "rate", copies.cast("long").alias("copies")), "rounded")

    # what is missing or too much in a source, taken up by single copies, large sizes first
    missing = rounded.groupBy("s", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("has")).select("s", (F.col("target") - F.col("has")).alias("missing"))
    able = rounded.where("size > 0").join(sent(missing), "s").where(((F.col("missing") > 0) & (F.col("copies") < MOST)) | ((F.col("missing") < 0) & (F.col("copies") > 0)))
    choices = able.groupBy("s", "missing", F.floor(F.log2("size")).alias("power")).agg(F.min(F.struct("size", F.xxhash64("doc_id").alias("h"), "doc_id", "text_hash", "nth")).alias("c"))
    folded = choices.groupBy("s", "missing").agg(F.sort_array(F.collect_list("c"), asc=False).alias("c"))
    left = lambda acc: acc["left"]
    took = choices.select(F.array(F.col("c")).alias("c")).schema["c"].dataType
    start = F.struct(F.abs("missing").alias("left"), F.array().cast(took).alias("took"))
    fold = F.aggregate("c", start, lambda acc, c: F.when(c["size"] <= left(acc) + 0.5, F.struct((left(acc) - c["size"]).alias("left"), F.concat(acc["took"], F.array(c)).alias("took"))).otherwise(acc))
    change = folded.select("s", F.explode(fold["took"]).alias("t"), F.signum("missing").cast("long").alias("change")).select(*[(F.col("s") if k == "s" else F.col(f"t.{k}")).alias(f"_{k}") for k in KEY], F.col("t.doc_id").alias("_id"), "change")
    final = rounded.join(_sent(wanted, 64)(change), _same(change), "left")
    copies = F.col("copies") + F.coalesce("change", F.lit(0))
    return final.select("doc_id", *KEY, "source", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _same(other: DataFrame) -> Column:
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    for k in KEY:
        same &= F.col(k) == F.col(f"_{k}")
    return same


def copied(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    # the row travels whole, so that its columns may have any names
    numbered = keyed(docs, F.struct("*").alias("row"))
    taken = mix(docs).where("copies > 0").select(F.col("doc_id").alias("_id"), *[F.col(k).alias(f"_{k}") for k in KEY], "copies")
    joined = numbered.join(taken, _same(taken))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
