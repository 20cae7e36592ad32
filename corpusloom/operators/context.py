"""Contexts, prompts, answers and lexical evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview
from .providers import Model, answered

MOST_DISTANCE = 1.2
NOTHING_FOUND = "Aucun passage des documents n'est assez proche de la question."
#: Roles by domain; an unknown domain has the last one.
ROLES = {"legal": "en droit", "municipal": "en documents municipaux", "medical": "en documents médicaux", "rh": "en ressources humaines", "technique": "en documentation technique", "tourisme": "en tourisme"}


class FirstPassage:
    """Offline default: the first passage of the prompt."""

    def answer(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            passage = p.partition("[Source : ")[2].partition("]\n")[2]
            out.append(passage.partition("\n\n---\n\n")[0].partition("\n\n## Question\n")[0])
        return out


def contexts(results: DataFrame, most: float = MOST_DISTANCE) -> DataFrame:
    """query_id, context: near enough passages (rank, source_file, document, distance) in rank order."""
    passage = F.concat(F.lit("[Source : "), F.coalesce("source_file", F.lit("source inconnue")), F.lit("]\n"), F.col("document"))
    near = F.when(F.coalesce("distance", F.lit(0.0)) <= most, F.struct("rank", passage.alias("passage")))
    return results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(near)), lambda x: x["passage"]), "\n\n---\n\n").alias("context"))


def prompt(question: Column, context: Column, domain: str) -> Column:
    role = ROLES.get(domain, ROLES["tourisme"])
    rules = f"Assistant spécialisé {role}. Répondre avec les seuls passages ci-dessous, sans rien inventer, en citant la source; sinon dire que l'information manque."
    return F.concat(F.lit(rules + "\n\n## Passages\n"), context, F.lit("\n\n## Question\n"), question)


def answers(asked: DataFrame, domain: str, model: Model | None = None) -> DataFrame:
    """``asked`` (question, context, ...) with answer; a prompt that fails, alone, has its error as the answer."""
    provider = model or FirstPassage()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series([f"error: {x}" if isinstance(x, Exception) else x for x in answered(provider, prompts.tolist())], dtype=object)

    full = prompt(F.col("question"), F.col("context"), domain)
    return asked.withColumn("answer", F.when(F.col("context") == "", NOTHING_FOUND).otherwise(run(full)))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s.,;:!?|]+"), lambda w: w != ""))


def lexical_scores(rows: DataFrame) -> DataFrame:
    """Stand-ins for a judge, from shared words of question, answer and context: faithfulness (answer words
    that the context has), answer_relevancy (question words that the answer has), context_precision
    (question words that the context has)."""
    q, a, c = (words(F.col(x)) for x in ("question", "answer", "context"))
    share = lambda x, y: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))
    return rows.withColumns({"faithfulness": share(a, c), "answer_relevancy": share(q, a), "context_precision": share(q, c)})


def shown(results: DataFrame, chars: int = 200) -> DataFrame:
    """Search results as they are displayed: distance with four digits, a few fields of the metadata, N/A for what is
    missing, and the beginning of the text."""
    missing = F.lit("N/A")
    fields = [F.coalesce(F.col("metadata")[k], missing).alias(k) for k in ("reference_complete", "dispositif", "chunk_type")]
    distance = F.coalesce(F.format_string("%.4f", "distance"), missing).alias("distance")
    return results.select("query_id", "rank", "id", distance, *fields, preview(F.col("document"), chars, always=True).alias("document"))
