"""Document metadata: normalisation, context prefixes, text form, and filters on stored metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_iso_date

# Spellings of outcomes and votes, sections worth naming, domains without a reference prefix.
OUTCOMES = {"cassation": "Cassation", "rejet": "Rejet", "irrecevabilité": "Irrecevabilité", "irrecevabilite": "Irrecevabilité", "annulation": "Annulation", "confirmation": "Confirmation", "infirmation": "Infirmation"}
VOTES = {"adopté": "Adopté", "adopte": "Adopté", "rejeté": "Rejeté", "rejete": "Rejeté", "ajourné": "Ajourné", "ajourne": "Ajourné", "unanimité": "Unanimité", "unanimite": "Unanimité"}
SECTIONS = ["procedure", "recevabilite", "motifs", "dispositif", "historique", "attractions", "presentation"]
NO_REFERENCE = ["tourisme", "municipal", "rh", "medical"]
FIELDS = ["document_id", "source_file", "source_type", "domain", "type_document", "date_decision", "annee_decision", "reference_complete", "objet", "collectivite", "numero_deliberation", "rapporteur", "vote_resultat", "service_emetteur", "seance_date", "juridiction", "chambre", "numero_pourvoi", "dispositif", "parties", "president", "presentation", "historique", "attractions", "acces", "contact", "date_ingestion"]


def _canonical(value: Column, spellings: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(value)), value)


def outcome(value: Column) -> Column:
    return _canonical(value, OUTCOMES)


def vote(value: Column) -> Column:
    return _canonical(value, VOTES)


def valid_date(value: Column) -> Column:
    return F.when(is_iso_date(value), value)


def year(value: Column, date: Column) -> Column:
    """The given year, or that of the date."""
    return F.coalesce(F.when(value != "", value), F.left(date, F.lit(4)))


def given(value: Column) -> Column:
    """Null, empty and 'null' mean missing."""
    return F.when(~value.isin("", "null"), value)


def enriched(text: Column, meta: dict[str, Column], chunk_type: Column, domain: str) -> Column:
    """The text after a bracketed line of what is known of its document; unchanged if nothing is."""
    missing = F.lit(None).cast("string")
    get = lambda name: given(meta.get(name, missing))
    court = F.concat(get("juridiction"), F.coalesce(F.concat(F.lit(", "), get("date_decision")), F.lit("")), F.coalesce(F.concat(F.lit(", n° "), get("numero_pourvoi")), F.lit("")))
    parts = [missing if domain in NO_REFERENCE else F.coalesce(get("reference_complete"), court), F.concat(F.lit("Résultat: "), get("dispositif")), F.when(chunk_type.isin(SECTIONS), F.concat(F.lit("Section: "), chunk_type))]
    prefix = F.concat_ws(" | ", *parts)
    return F.when(prefix == "", text).otherwise(F.concat(F.lit("["), prefix, F.lit("]\n\n"), text))


def stringified(fields: dict[str, tuple[Column, str]]) -> Column:
    """name -> (column, type) as a map of texts without missing values; arrays as JSON, null arrays as []."""
    pairs = []
    for name, (column, kind) in fields.items():
        text = F.to_json(F.coalesce(column, F.array().cast(kind))) if kind.startswith("array") else column.cast("string")
        pairs += [F.lit(name), text]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _number(column: Column, kind: str) -> Column:
    return column if kind == "number" else column.try_cast("double")


def _compared(column: Column, kind: str, op: str, value) -> Column:
    """One comparison. Numbers are compared as numbers, other values as texts."""
    numeric = isinstance(value, (int, float)) and not isinstance(value, bool)
    left, right = (_number(column, kind), F.lit(value)) if numeric else (column.cast("string") if kind == "number" else column, F.lit(str(value)))
    match op:
        case "$eq":
            return left == right
        case "$ne":
            return left != right
        case "$gt":
            return left > right
        case "$gte":
            return left >= right
        case "$lt":
            return left < right
        case "$lte":
            return left <= right
        case "$contains":
            return F.contains(column.cast("string"), F.lit(str(value)))
    raise ValueError(f"unknown operator {op!r}")


def where(metadata: Column, condition: dict, columns: dict[str, Column] | None = None, numbers: tuple[str, ...] = ()) -> Column:
    """A filter dictionary ({key: value}, {key: {$op: value}}, $and, $or) as a Column. Keys of ``columns`` are these columns, so
    that the filter can reach the scan; others are looked up in the map. A number as operand is compared with numbers
    (texts that are none match nothing), any other value with texts; ``numbers`` names the columns that hold numbers."""
    out = []
    for key, value in condition.items():
        if key in ("$and", "$or"):
            parts = [where(metadata, c, columns, numbers) for c in value]
            out.append(reduce(lambda a, b: a & b if key == "$and" else a | b, parts))
            continue
        column, kind = (columns or {}).get(key, metadata[key]), "number" if key in numbers else "text"
        for op, operand in (value if isinstance(value, dict) else {"$eq": value}).items():
            if op in ("$in", "$nin"):
                texts = all(isinstance(x, str) for x in operand) and kind == "text"
                any_of = column.isin(list(operand)) if texts else reduce(lambda a, b: a | b, [_compared(column, kind, "$eq", x) for x in operand], F.lit(False))
                out.append(any_of if op == "$in" else ~any_of)
            else:
                out.append(_compared(column, kind, op, operand))
    return reduce(lambda a, b: a & b, out, F.lit(True))
