"""String, date and label functions, as Columns. White space and digits are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# French month names, and the parts of a key that mark an identifier.
MONTHS = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]
ID_PARTS = ["id", "code", "ref", "numero", "num"]
#: Forms of ISO dates and times that are accepted, after a final Z became +00:00.
_DAY = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(-[1-7])?|\d{4}W\d{2}[1-7]?)"
_TIME = r"(.(\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?|\d{4}(\d{2}([.,]\d+)?)?)([+-]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?)?)?"


def strip(text: Column) -> Column:
    """Without white space at its ends; most texts have none, which their first and last character tell."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside lambdas, expressions that repeat are otherwise repeated."""
    return F.transform(F.array(value), use)[0]


def label(key: Column) -> Column:
    """Underscores to spaces, each run of letters capitalised."""
    runs = F.regexp_extract_all(F.replace(key, F.lit("_"), F.lit(" ")), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 30)))), "")


def iso_date(text: Column) -> Column:
    """The calendar day of an ISO date or time, null if it is none."""
    day = F.coalesce(
        F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"),
        F.try_to_date(F.regexp_extract(text, r"^(\d{8})", 1), "yyyyMMdd"),
    )
    year = F.regexp_extract(text, r"^(\d{4})-?W(\d{2})", 1).try_cast("int")
    week = F.regexp_extract(text, r"^(\d{4})-?W(\d{2})", 2).try_cast("int")
    of_week = F.coalesce(F.regexp_extract(text, r"^\d{4}-?W\d{2}-?([1-7])", 1).try_cast("int"), F.lit(1))
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    in_week = F.date_add(fourth, ((week - 1) * 7 + of_week - 1 - F.weekday(fourth)).cast("int"))
    in_week = F.when((week >= 1) & (F.weekofyear(in_week) == week), in_week)
    after = F.regexp_replace(text, f"^{_DAY}.", "")
    hour = F.regexp_extract(after, r"^(\d{2})", 1).try_cast("int")
    minute = F.regexp_extract(after, r"^\d{2}:?(\d{2})", 1).try_cast("int")
    second = F.regexp_extract(after, r"^\d{2}:?\d{2}:?(\d{2})", 1).try_cast("int")
    bare = text.rlike(f"^{_DAY}$")
    good = bare | F.coalesce(hour < 24, F.lit(True)) & F.coalesce(minute < 60, F.lit(True)) & F.coalesce(second < 60, F.lit(True))
    whole = F.replace(text, F.lit("Z"), F.lit("+00:00")).rlike(f"^{_DAY}{_TIME}$")
    return F.when(whole & good, F.when(text.rlike("^.{4}-?W"), in_week).otherwise(day))


def is_iso_date(text: Column) -> Column:
    return F.coalesce(iso_date(text).isNotNull(), F.lit(False))


def french_date(text: Column) -> Column:
    """'4 novembre 2025'; other texts unchanged."""
    d = iso_date(text)
    return F.coalesce(F.when(d.isNotNull(), F.concat_ws(" ", F.day(d).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d)), F.year(d).cast("string"))), text)


def is_structured(key: Column, value: Column) -> Column:
    """An identifier by its key, or a short value without a space."""
    return F.lower(key).rlike("|".join(ID_PARTS)) | ((F.length(value) < 50) & ~F.contains(value, F.lit(" ")))


def preview(text: Column, n: int, always: bool = False) -> Column:
    cut = F.concat(F.left(text, F.lit(n)), F.lit("..."))
    return cut if always else F.when(F.length(text) > n, cut).otherwise(text)
