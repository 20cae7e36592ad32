from corpusloom.operators import extraction


def run(spark, answers, domain):
    class Fixed:
        def answer(self, prompts):
            if answers is None:
                raise RuntimeError("down")
            return [answers] * len(prompts)

    return extraction.extract(spark.createDataFrame([("text",)], "text string"), domain, Fixed()).first().extracted


def test_extraction(spark):
    assert run(spark, '{"date_decision": "2024-03-15", "dispositif": "REJET", "x": null}', "legal") == {"date_decision": "2024-03-15", "annee_decision": "2024", "dispositif": "Rejet", "x": None}
    assert run(spark, '{"date_decision": "2024-13-01", "vote_resultat": "ADOPTE", "annee_decision": "2023"}', "municipal") == {"annee_decision": "2023", "vote_resultat": "Adopté"}
    assert run(spark, "no json", "rh") == {} and run(spark, None, "rh") == {}
    assert extraction.fields("unknown") == extraction.fields("tourisme")


class _Picky:
    """Fails for whole batches that hold a bad prompt."""

    def answer(self, prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("can't say")
        return [f'{{"objet": "{len(p)}"}}' for p in prompts]


def test_only_the_failing_prompt_is_lost(spark):
    from corpusloom.operators import context, providers

    prompts = ["a", "bad", "ccc", "dd", "bad one"]
    got = providers.answered(_Picky(), prompts)
    assert [isinstance(x, RuntimeError) for x in got] == [False, True, False, False, True] and got[2] == '{"objet": "3"}'
    assert providers.answered(_Picky(), []) == []

    class Short:
        def answer(self, prompts):
            return prompts[:1]

    assert providers.answered(Short(), ["a", "b", "c"]) == ["a", "b", "c"]
    rows = spark.createDataFrame([(i, p, "c") for i, p in enumerate(prompts)], "id int, question string, context string").coalesce(1)
    answers = {r.id: r.answer for r in context.answers(rows, "legal", _Picky()).collect()}
    assert answers[1] == answers[4] == "error: can't say" and all("objet" in answers[i] for i in (0, 2, 3))
    docs = rows.withColumnRenamed("question", "text")
    found = {r.id: r.extracted for r in extraction.extract(docs, "rh", _Picky()).collect()}
    assert found[1] == found[4] == {} and all("objet" in found[i] for i in (0, 2, 3))
