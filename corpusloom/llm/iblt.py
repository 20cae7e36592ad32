"""Document fingerprints by invertible Bloom lookup sketches, with DataFrame functions only.

A text's paragraphs (its lines; long lines are cut after sentences) become 64-bit digests. A sketch has
three rows of cells; a digest is added to one cell of each: count, xor of digests, xor of their checks.
Two sketches subtract cell by cell, and peeling cells that hold a single digest recovers the digests in
which two versions differ. The fingerprint is the sketch of ``CELLS`` cells a row. Where it is too small
for a difference, both versions are sketched again larger, in groups by digest bits, and a group that still
fails again with larger rows, at last by other bits. The likeness is shared digests over all digests.

Defined results: a null text is empty; two texts without paragraphs have likeness 1; paragraphs that repeat
count once; null ids come last in the order of documents; documents with equal ids are ordered by a hash
of the text; a single document is its own next. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CELLS, LARGER, LARGEST = 8, 64, 512
#: Cells a row and first bit of the rows' places, of the sketches that a group is tried with. Two digests that no
#: sketch tells apart agree in 54 bits.
TRIES = [(CELLS, 0), (LARGER, 0), (LARGEST, 0), (LARGEST, 27)]
#: Digests that a group of a larger sketch should hold, at most, of both versions.
GROUP = 6
ROUNDS = 8
#: Paragraphs are lines; longer lines are cut after a sentence of 200 to 600 characters, or else at 600.
PARAGRAPH = r"[^\n]{200,600}?[.!?](?=\s)|[^\n]{1,600}"
#: Documents are ordered in ranges of about so many bytes; up to RANGES of them follow the distribution of the ids,
#: and are cut evenly once more if there have to be more.
RANGE_BYTES, RANGES = 4 << 20, 1024
#: Tables of a row a range up to so many rows are sent to all tasks.
BROADCAST_ROWS = 100_000


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value found once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _places(cells: int, base: int = 0) -> Column:
    """shift and slot of every cell; Spark folds this to a constant."""
    return F.transform(F.sequence(F.lit(0), F.lit(3 * cells - 1)), lambda i: F.struct((F.floor(i / cells) * 9 + base).cast("int").alias("shift"), (i % cells).cast("long").alias("slot")))


def _hit(digest: Column, place: Column, cells: int) -> Column:
    return F.call_function("shiftrightunsigned", digest, place["shift"]).bitwiseAND(F.lit(cells - 1).cast("long")) == place["slot"]


def _cell(n: Column, x: Column, check: Column) -> Column:
    return F.struct(n.alias("n"), x.alias("x"), check.alias("check"))


def sketch(keys: Column, cells: int = CELLS, base: int = 0) -> Column:
    """array of (n, x, check), three rows of ``cells`` one after the other."""
    zero = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    return F.transform(
        _places(cells, base),
        lambda p: F.aggregate(keys, zero, lambda a, k: F.when(_hit(k, p, cells), _cell(a["n"] + 1, a["x"].bitwiseXOR(k), a["check"].bitwiseXOR(F.xxhash64(k)))).otherwise(a)),
    )


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["x"].bitwiseXOR(y["x"]), x["check"].bitwiseXOR(y["check"])))


def peel(difference: Column, cells: int = CELLS, base: int = 0) -> Column:
    """The digests x in which the two versions differ, with n = 1 for those of the first and -1 for those of the
    second; null if the sketch is too small to tell."""

    def step(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (F.xxhash64(c["x"]) == c["check"])), lambda c: F.struct(c["n"].alias("n"), c["x"].alias("x"))))

        def next_state(found: Column) -> Column:
            def taken(c: Column, p: Column) -> Column:
                return F.aggregate(found, c, lambda a, k: F.when(_hit(k["x"], p, cells), _cell(a["n"] - k["n"], a["x"].bitwiseXOR(k["x"]), a["check"].bitwiseXOR(F.xxhash64(k["x"])))).otherwise(a))

            left = F.zip_with(state["cells"], _places(cells, base), taken)
            return F.struct(F.when(F.size(found) > 0, left).otherwise(state["cells"]).alias("cells"), F.concat(state["found"], found).alias("found"), (F.size(found) == 0).alias("done"))

        return F.when(state["done"], state).otherwise(_let(pure, next_state))

    start = F.struct(difference.alias("cells"), F.array().cast("array<struct<n:int,x:bigint>>").alias("found"), F.lit(False).alias("done"))
    end = lambda s: F.when(F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["x"] == 0)), s["found"])
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step, end)


def differing(a: Column, b: Column) -> Column:
    """The digests in which a and b differ, like ``peel``, from sketches in groups that are larger together than the
    fingerprint. The groups are found in two steps, so that each digest is looked at for few of them."""
    total = F.size(a) + F.size(b)
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.lit(1), total) / GROUP))).cast("int")
    first = F.floor(bits / 2).cast("int")
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)

    def of(keys: Column, shift: Column, n: Column, g: Column) -> Column:
        return F.filter(keys, lambda k: F.call_function("shiftrightunsigned", F.xxhash64(k), shift).bitwiseAND(n - 1) == g)

    def split(m: Column, shift: Column, n: Column, f: Callable[[Column], Column]) -> Column:
        part = lambda g: F.struct(of(m["a"], shift, n, g).alias("a"), of(m["b"], shift, n, g).alias("b"))
        return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda g: _let(part(g), f)))

    def tried(m: Column) -> Column:
        sizes = [peel(subtract(sketch(m["a"], c, at), sketch(m["b"], c, at)), c, at) for c, at in TRIES]
        return F.coalesce(*sizes, F.raise_error(F.lit("digests agree in 54 bits")).cast("array<struct<n:int,x:bigint>>"))

    return split(F.struct(a.alias("a"), b.alias("b")), F.lit(20), power(first), lambda m: split(m, F.lit(36), power(bits - first), tried))


def recovered(a_keys: Column, b_keys: Column) -> Column:
    """The digests in which two versions differ, from their fingerprints if these are large enough."""
    return F.coalesce(peel(subtract(sketch(a_keys), sketch(b_keys))), differing(a_keys, b_keys))


def likeness(a_keys: Column, a: Column, b_keys: Column, b: Column) -> Column:
    d = F.size(F.coalesce(peel(subtract(a, b)), differing(a_keys, b_keys)))
    total = F.size(a_keys) + F.size(b_keys)
    return F.when(total == 0, F.lit(1.0)).otherwise(_let(d, lambda n: (total - n) / (total + n)))


def text_of(cells: Column) -> Column:
    return F.lower(F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["x"]), F.hex(c["check"]))), ","))


def ranged(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, order: ranges of the order of documents, later ones have smaller numbers. Ranges between
    quantiles of all ids are cut again at quantiles of their own ids, so gaps between ids don't matter. Ids that many
    rows share, and null ids, are cut by ``order``, a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / RANGES for i in range(RANGES + 1)]
    known = rows.agg(F.percentile_approx("doc_id", shares, 10 * RANGES).alias("ids"), F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ids, wanted = known["ids"] or [0], max(1, -(-(known["bytes"] or 0) // RANGE_BYTES))
    n = min(wanted, RANGES)
    parts = min(RANGES, -(-wanted // n))
    hot = [i for i, times in Counter(ids).items() if times > 2] if known["n"] > 10 * RANGES else []
    bounds = sorted({ids[i * (len(ids) - 1) // n] for i in range(n + 1)} | set(hot))
    edges = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    spot = F.size(F.filter(edges, lambda b: b <= F.col("doc_id")))
    rows = rows.withColumn("spot", spot).withColumn("order", F.xxhash64("text"))
    fine = F.lit(0)
    if parts > 1:
        # at most RANGES * RANGES numbers
        cuts = rows.where("doc_id is not null").groupBy("spot").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * RANGES).alias("cuts"))
        rows = rows.join(F.broadcast(stored(cuts, "cuts")), "spot", "left")
        fine = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<long>")), lambda c: c <= F.col("doc_id")))
    by_text = F.least(F.lit(n - 1), F.floor((F.col("order").cast("double") / 2.0**64 + 0.5) * n))
    in_range = F.when(F.col("doc_id").isin(hot), n - 1 - by_text).otherwise(n + fine)
    bucket = F.when(F.col("doc_id").isNull(), -1 - by_text).otherwise(F.col("spot") * (n + parts) + in_range).cast("long")
    return rows.select("doc_id", "text", bucket.alias("bucket"), "order")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, keys, cells of every row, with next_text, next_keys, next_cells of the row that follows
    in descending id order; the first follows the last. One shuffle of the texts, by ranges of ids."""
    dealt = ranged(docs)
    # the first row of the next range, and after the last range that of the first, ends each range
    down = F.bitwise_not(F.col("doc_id"))
    tops = stored(dealt.groupBy("bucket").agg(F.min(F.struct(down.alias("down"), "order")).alias("top")), "ranges")
    sent = F.broadcast if tops.count() <= BROADCAST_ROWS else lambda df: df
    found = dealt.join(sent(tops), "bucket").where(down.eqNullSafe(F.col("top.down")) & (F.col("order") == F.col("top.order")))
    heads = found.groupBy("bucket").agg(F.first("text").alias("text"))
    narrow = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))
    turns = tops.select("bucket", F.coalesce(F.lead("bucket").over(narrow), F.first("bucket").over(narrow)).alias("next"))
    ends = sent(turns).join(heads.select(F.col("bucket").alias("next"), "text"), "next").select(F.lit(None).cast("long").alias("doc_id"), "text", "bucket", F.lit(None).cast("long").alias("order"), F.lit(True).alias("end"))
    both = dealt.withColumn("end", F.lit(False)).unionByName(ends)

    sketched = both.repartition("bucket").withColumn("keys", digests(F.col("text"))).withColumn("cells", sketch(F.col("keys")))
    order = Window.partitionBy("bucket").orderBy("end", F.col("doc_id").desc_nulls_last(), "order")
    for c in ("text", "keys", "cells"):
        sketched = sketched.withColumn(f"next_{c}", F.lead(c).over(order))
    return sketched.where(~F.col("end"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text)."""
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.when(half > 0, F.substr("next_text", F.lit(1), half)).otherwise(F.lit("")))
    rows = rows.withColumn("edited", edited).withColumn("edited_keys", digests(F.col("edited"))).withColumn("edited_cells", sketch(F.col("edited_keys")))
    k = F.col
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        text_of(k("cells")).alias("fingerprint"),
        text_of(k("edited_cells")).alias("edited_fingerprint"),
        likeness(k("keys"), k("cells"), k("edited_keys"), k("edited_cells")).alias("near_edited"),
        likeness(k("keys"), k("cells"), k("next_keys"), k("next_cells")).alias("near_next"),
    )
