"""Chunkers as Columns: text -> array of texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of a section, by domain.
SECTION_SIGNS = {
    "legal": {"procedure": "(?:Sur le pourvoi|Vu le pourvoi)", "recevabilite": "Sur la recevabilité", "motifs": "(?:Considérant que|Attendu que)", "dispositif": "PAR CES MOTIFS"},
    "tourisme": {"hotel": "(HÔTEL|HOTEL|AUBERGE|RÉSIDENCE|MÔTEL)"},
}


def sliding_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each ``size - overlap`` after the one before. Empty text has none;
    a text up to ``size`` long is one. The last window may lie within the one before it."""
    step = size - overlap
    if step <= 0 or overlap < 0:
        raise ValueError("overlap must be at least 0 and less than size")
    starts = F.sequence(F.lit(0), F.ceil(F.length(text) / step).cast("int") - 1)
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>"))
        .when(F.length(text) <= size, F.array(text))
        .otherwise(F.transform(starts, lambda i: F.substr(text, i * step + 1, F.lit(size))))
    )


#: Texts that a worker cuts in one step: their chunks go out before the next texts are cut.
STEPS = 128
# White space as (?U)\s has it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK_LINES = re.compile(rf"\n[{_SPACE}]*\n")
# white space after the end of a sentence; to begin with the class is what makes the search fast
_AFTER_SENTENCE = re.compile(rf"[{_SPACE}](?<=[.!?].)[{_SPACE}]*", re.DOTALL)


def _tail(text: str, size: int) -> str:
    """The last two sentences, or the last ``size`` characters where there are at most two."""
    found = _AFTER_SENTENCE.split(text.strip(_SPACE))
    return " ".join(found[-2:]) if len(found) > 2 else text[-size:] if size > 0 else ""


def _fold(parts: list[str], joint: str, size: int, overlap: int, large: Callable[[str], list[str]] | None = None) -> list[str]:
    """Join parts up to ``size``; a chunk that is put out leaves its tail as the start of the next. A part over the size goes
    through ``large``, if given, and is put out at once, before what is waiting."""
    now, out = "", []
    for part in parts:
        if large is not None and len(part) > size:
            out += large(part)
        elif len(now) + len(part) <= size:
            now += joint + part
        else:
            out.append(now.strip(_SPACE))
            now = _tail(now, overlap) + joint + part
    last = now.strip(_SPACE)
    return [*out, last] if last else out


def _structural(text: str | None, size: int, overlap: int) -> list[str] | None:
    if text is None:
        return None
    if len(text) < size:
        return [text]
    blocks = [b for b in (x.strip(_SPACE) for x in _BLANK_LINES.split(text)) if b]
    return _fold(blocks, "\n", size, overlap, lambda part: _fold(_AFTER_SENTENCE.split(part), " ", size, overlap))


def structural_chunks(text: Column, size: int = 1500, overlap: int = 400) -> Column:
    """Texts shorter than ``size`` are one chunk; others are cut into paragraphs (between blank lines), over-long paragraphs
    into sentences, and joined again up to ``size``. A sentence is never cut."""
    steps = STEPS

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for at in range(0, len(texts), steps):
                yield pd.Series([_structural(x, size, overlap) for x in texts.iloc[at : at + steps]], dtype=object)

    return run(text)


def section(chunk: Column, domain: str) -> Column:
    """The section whose sign comes first in the chunk (of signs at one place, the first of the domain's); null without a
    sign, and in domains without signs."""
    signs = SECTION_SIGNS.get(domain, {})
    if not signs:
        return F.lit(None).cast("string")
    place = lambda sign: F.regexp_instr(chunk, F.lit(sign))
    found = F.filter(F.array(*[F.struct(place(sign).alias("at"), F.lit(i).alias("nth"), F.lit(name).alias("name")) for i, (name, sign) in enumerate(signs.items())]), lambda x: x["at"] > 0)
    return F.get(F.array_sort(found), 0)["name"]
