"""Metadata extraction by a language model, checked and normalised."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata
from .providers import Model, answered

HEAD = 1500
# The fields of each domain; an unknown domain has those of the last.
FIELDS = {
    "legal": ["juridiction", "chambre", "date_decision", "annee_decision", "numero_pourvoi", "reference_complete", "dispositif", "parties", "president", "type_document"],
    "municipal": ["collectivite", "type_document", "numero_deliberation", "date_decision", "annee_decision", "seance_date", "objet", "rapporteur", "service_emetteur", "vote_resultat", "reference_complete"],
    "medical": ["type_document", "date_decision", "service_emetteur", "objet", "reference_complete"],
    "rh": ["type_document", "date_decision", "service_emetteur", "objet", "reference_complete"],
    "tourisme": ["type_document", "reference_complete", "presentation", "historique", "attractions", "acces", "contact"],
}


def fields(domain: str) -> list[str]:
    return FIELDS.get(domain, FIELDS["tourisme"])


def prompt_head(domain: str) -> str:
    return f"Donner en JSON les champs {', '.join(fields(domain))} du document; null si le document ne dit rien; dates AAAA-MM-JJ.\n\n"


def prompt(text: Column, domain: str) -> Column:
    return F.concat(F.lit(prompt_head(domain)), F.left(text, F.lit(HEAD)))


def validated(meta: Column, domain: str) -> Column:
    """Dates that are none become null, a missing year is taken from the date, outcomes and votes get one spelling."""
    date = metadata.valid_date(meta["date_decision"])
    changed = {"date_decision": date, "seance_date": metadata.valid_date(meta["seance_date"]), "annee_decision": metadata.year(meta["annee_decision"], date)}
    if domain == "legal":
        changed["dispositif"] = metadata.outcome(meta["dispositif"])
    if domain == "municipal":
        changed["vote_resultat"] = metadata.vote(meta["vote_resultat"])
    kept = F.map_filter(meta, lambda k, _: ~k.isin(*changed))
    new = F.map_filter(F.create_map(*[x for k, v in changed.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return F.map_concat(kept, new)


def extract(docs: DataFrame, domain: str, model: Model) -> DataFrame:
    """``docs`` (text, ...) with extracted: map of the model's fields; empty where it fails for a text, or gives no JSON object."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series([None if isinstance(x, Exception) else x for x in answered(model, prompts.tolist())], dtype=object)

    filled = docs.withColumn("extracted", F.from_json(run(prompt(F.col("text"), domain)), "map<string,string>"))
    return filled.withColumn("extracted", validated(F.coalesce("extracted", F.create_map().cast("map<string,string>")), domain))


def extract_from_text(docs: DataFrame, model: Model, source_type: str = "pdf", domain: str = "tourisme") -> DataFrame:
    """Another name of ``extract``; the kind of source makes no difference."""
    return extract(docs, domain, model)
