"""License scans by diagonal voting, with DataFrame functions only.

The rolling ``K``-word hashes of a text are joined to the positions of the same hashes in the license
templates (a fixed, small table, broadcast); a bit table of the templates' hashes keeps most others from the join.
A hit has the template's words, not only their hash, and votes for its diagonal, word position minus template
position. Neighbouring diagonals of a template, which differ by inserted or missing words, are merged to
spans; a span stands if the words verified in it cover enough of its template and it is not stretched. A diagonal
that has every run of words of its template is an exact place.

Defined results: a null or empty text has no words and no places, its labels are '' and its score 0; rows
that repeat are reported each; ids may be null. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

K = 3
#: Diagonals of one template that are at most so far apart are one span.
NEAR = 2
#: Share of a template's hashes that a span must cover; more of short templates, which differ in a word or two.
COVER, COVER_SHORT, SHORT = 0.6, 0.8, 12
#: 64-bit words of the bit table.
BIT_WORDS = 512
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Fixed values: (label, words). The first three are the base phrases.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
TEMPLATES = [
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _run(w: Column, i: Column) -> Column:
    return F.array_join(F.slice(w, i + 1, K), " ")


def rolling(w: Column) -> Column:
    """place and gram, the hash, of all K-word runs."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.struct(i.alias("place"), F.xxhash64(*(w[i + j] for j in range(K))).alias("gram")))
    return F.when(F.size(w) >= K, grams).otherwise(F.array().cast("array<struct<place:int,gram:bigint>>"))


def candidates(w: Column, grams: list[int]) -> Column:
    """place, gram and run, the words themselves, of the runs whose hash may be one of ``grams``."""
    bits = [0] * BIT_WORDS
    for g in grams:
        bits[g % (64 * BIT_WORDS) // 64] |= 1 << g % 64
    table = F.array(*[F.lit(b - (1 << 64) if b >> 63 else b).cast("long") for b in bits])
    place = lambda x: F.shiftrightunsigned(x["gram"].bitwiseAND(64 * BIT_WORDS - 1), 6).cast("int") + 1
    hit = lambda x: F.call_function("shiftrightunsigned", F.element_at(table, place(x)), x["gram"].bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return F.transform(F.filter(rolling(w), hit), lambda x: F.struct(x["place"].alias("place"), x["gram"].alias("gram"), _run(w, x["place"]).alias("run")))


def template_grams(spark: SparkSession, base: list[tuple[str, str]], more: list[tuple[str, str]]) -> DataFrame:
    rows = [(n, label, n < len(base), text) for n, (label, text) in enumerate([*base, *more])]
    t = spark.createDataFrame(rows, "template int, label string, is_base boolean, text string").withColumn("w", words(F.col("text")))
    g = t.select("template", "label", "is_base", "w", (F.size("w") - (K - 1)).alias("grams"), F.explode(rolling(F.col("w"))).alias("g"))
    return g.select("template", "label", "is_base", "grams", F.col("g.place").alias("at"), F.col("g.gram").alias("gram"), _run(F.col("w"), F.col("g.place")).alias("run"))


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text)."""
    grams = template_grams(docs.sparkSession, base, templates)
    known = [r.gram for r in grams.select("gram").distinct().collect()]  # the templates' own
    # the one-element array names the words, so that a text is cut once
    of_text = F.transform(F.array(words(F.col("text"))), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), candidates(w, known).alias("runs")))
    cut = stored(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.element_at(of_text, 1).alias("x")).select("doc_id", "text_hash", "x.*"), "runs")
    key = ["doc_id", "text_hash"]
    # repeated rows give the same hits twice, hence the grouping by both positions
    hits = (
        cut.select(*key, F.explode("runs").alias("r"))
        .select(*key, "r.*")
        .join(F.broadcast(grams), ["gram", "run"])
        .groupBy(*key, "template", "label", "is_base", "grams", "place", "at")
        .agg(F.lit(1).alias("vote"))
    )
    diagonals = hits.groupBy(*key, "template", "label", "is_base", "grams", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("place").alias("first_place"), F.max("place").alias("last_place"), F.collect_set("at").alias("covered")
    )
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    spans = (
        diagonals.withColumn("fresh", F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= NEAR, 0).otherwise(1))
        .withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "template", "label", "is_base", "grams", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("covered"),
            F.min("first_place").alias("start"),
            F.max("last_place").alias("end"),
            F.collect_list(F.when(F.col("is_base") & (F.col("votes") == F.col("grams")), F.col("diagonal"))).alias("exact"),
        )
        .withColumn("cover", F.col("covered") / F.col("grams"))
        .withColumn("stands", (F.col("cover") >= F.when(F.col("grams") <= SHORT, COVER_SHORT).otherwise(COVER)) & ((F.size("exact") > 0) | (~F.col("is_base") & (F.col("end") - F.col("start") < 2 * (F.col("grams") + K)))))
    )
    found = spans.groupBy(*key).agg(
        F.sum(F.size("exact")).alias("n_base"),
        F.min(F.array_min("exact")).cast("long").alias("first_word"),
        F.max(F.array_max("exact")).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.size("exact") > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("stands"), F.col("label")))), ",").alias("labels"),
        F.max(F.when(F.col("stands"), F.col("cover"))).alias("score"),
    )
    rows = cut.select(*key, "n_words")
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & rows["text_hash"].eqNullSafe(found["text_hash"])
    return rows.join(found, same, "left").select(
        rows["doc_id"],
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for ``scan`` over ``documents``, on the words themselves."""
    values = ", ".join(f"({n}, '{label}', {str(n < len(BASE)).lower()}, string_split('{text}', ' '))" for n, (label, text) in enumerate([*BASE, *TEMPLATES]))
    return rf"""
with t(template, label, is_base, w) as (values {values}),
g as (select template, label, is_base, len(w) - 2 as grams, unnest(range(0, len(w) - 2)) as a, w from t),
gram as (select template, label, is_base, grams, a, w[a + 1] || ' ' || w[a + 2] || ' ' || w[a + 3] as gram from g),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
p as (select doc_id, unnest(range(0, len(w) - 2)) as place, w from d where len(w) >= 3),
hit as (select doc_id, template, label, is_base, grams, place, a from (select doc_id, place, w[place + 1] || ' ' || w[place + 2] || ' ' || w[place + 3] as gram from p) join gram using (gram)),
diag as (select doc_id, template, label, is_base, grams, place - a as diagonal, count(*) as votes, min(place) as lo, max(place) as hi, list(distinct a) as covered from hit group by doc_id, template, label, is_base, grams, place - a),
fresh as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) <= {NEAR} then 0 else 1 end as f from diag),
span as (select *, sum(f) over (partition by doc_id, template order by diagonal rows unbounded preceding) as span from fresh),
merged as (select doc_id, template, label, is_base, grams, span, len(list_distinct(flatten(list(covered)))) / grams as cover, min(lo) as lo, max(hi) as hi,
  count(*) filter (is_base and votes = grams) as n_exact, min(diagonal) filter (is_base and votes = grams) as first_exact, max(diagonal) filter (is_base and votes = grams) as last_exact from span group by doc_id, template, label, is_base, grams, span),
stand as (select *, cover >= case when grams <= {SHORT} then {COVER_SHORT} else {COVER} end and (n_exact > 0 or (not is_base and hi - lo < 2 * (grams + {K}))) as stands from merged),
found as (select doc_id, sum(n_exact)::bigint as n_base, min(first_exact) as first_word, max(last_exact) as last_word,
  string_agg(distinct label, ',' order by label) filter (n_exact > 0) as base_labels, string_agg(distinct label, ',' order by label) filter (stands) as labels, max(cover) filter (stands) as score from stand group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, round(coalesce(score, 0.0), 6) as score from d left join found using (doc_id)
"""
