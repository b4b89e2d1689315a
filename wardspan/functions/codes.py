"""Diagnosis-code helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: chapters of diagnosis codes ---------------------------------
# version 10, by first letter
CHAPTERS_10 = {
    "Infectious": "AB", "Neoplasm": "C", "Neoplasm/Blood": "D", "Endocrine/Metabolic": "E",
    "Mental": "F", "Nervous": "G", "Eye/Ear": "H", "Circulatory": "I", "Respiratory": "J",
    "Digestive": "K", "Skin": "L", "Musculoskeletal": "M", "Genitourinary": "N", "Pregnancy": "O",
    "Perinatal": "P", "Congenital": "Q", "Symptoms/Signs": "R", "Injury": "S",
    "Injury/Poisoning": "T", "External causes": "VWXY", "Factors/Encounter": "Z",
}
# version 9, by the first three digits; each chapter ends at the number given
CHAPTERS_9 = [
    (139, "Infectious"), (239, "Neoplasm"), (279, "Endocrine/Metabolic"), (289, "Blood"),
    (319, "Mental"), (389, "Nervous/Sense"), (459, "Circulatory"), (519, "Respiratory"),
    (579, "Digestive"), (629, "Genitourinary"), (679, "Pregnancy"), (709, "Skin"),
    (739, "Musculoskeletal"), (759, "Congenital"), (779, "Perinatal"), (799, "Symptoms/Signs"),
    (999, "Injury"),
]
UNKNOWN = "Unknown"


def chapter(code: Column, version: Column) -> Column:
    """Chapter name of a code; anything unmappable is ``Unknown``, never NULL."""
    c = F.upper(F.trim(code))
    first, head = F.substring(c, 1, 1), F.substring(c, 1, 3)
    ten = F.lit(None).cast("string")
    for name, letters in reversed(CHAPTERS_10.items()):
        ten = F.when(first.isin(*letters), name).otherwise(ten)
    # a shorter code is read as the number it shows
    n = F.when(head.rlike("^[0-9]+$"), head.cast("int"))
    nine = F.when(first == "V", "Factors/Encounter").when(first == "E", "External causes")
    for last, name in CHAPTERS_9:
        nine = nine.when(n.between(1, last), name)
    return F.coalesce(F.when(version == 10, ten).otherwise(F.when(version.isNotNull(), nine)), F.lit(UNKNOWN))


def prefix_rule(code: Column, rule: str) -> Column:
    """Test a code against a rule text of blank-separated prefixes and prefix ranges.

    ``I21`` matches codes starting with it, ``430-438`` those whose prefix of that length lies
    between the two (compared as text).
    """
    by_len: dict[int, list[str]] = {}
    tests: list[Column] = []
    for part in rule.split():
        if "-" in part:
            lo, hi = part.split("-")
            tests.append(F.substring(code, 1, len(lo)).between(lo, hi))
        else:
            by_len.setdefault(len(part), []).append(part)
    tests += [F.substring(code, 1, n).isin(*ps) for n, ps in by_len.items()]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def prefix_flag(code: Column, version: Column, nine: str, ten: str) -> Column:
    """1 where the code matches the rule of its version, else 0."""
    hit = F.lit(False)
    if ten:
        hit = hit | (F.coalesce(version == 10, F.lit(False)) & prefix_rule(code, ten))
    if nine:
        hit = hit | (F.coalesce(version == 9, F.lit(False)) & prefix_rule(code, nine))
    return hit.cast("int")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Case-insensitive test for any of the words, as one alternation."""
    import re

    return F.lower(text).rlike("|".join(re.escape(w.lower()) for w in words))


def code_token(text: Column) -> Column:
    """Whitespace runs collapsed to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def mapped(value: Column, names: dict[str, str]) -> Column:
    """Value replaced by its name in the table, or kept if it has none."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), value)
