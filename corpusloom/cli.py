"""python -m corpusloom.cli --corpus FOLDER [--retriever recursive|parent-child] [--reset] [--update] QUESTION..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import context
from .plans.engine import MODES, Engine


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--corpus", required=True)
    parser.add_argument("--retriever", choices=MODES, default=MODES[0])
    parser.add_argument("--reset", action="store_true")
    parser.add_argument("--update", action="store_true", help="index files that are new or changed")
    parser.add_argument("questions", nargs="*")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    engine = Engine(spark, mode=given.retriever)
    engine.ingest_corpus(given.corpus, force=given.reset, update=given.update).show(truncate=False)
    if given.questions:
        asked = spark.createDataFrame(list(enumerate(given.questions)), "query_id long, question string")
        found = engine.search(asked)
        context.shown(found).orderBy("query_id", "rank").show(truncate=False)
        engine.answer(asked).select("question", "answer").show(truncate=False)


if __name__ == "__main__":
    main()
