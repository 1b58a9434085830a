"""Company names without their places, and aliases: a small Arrow helper, since stripping repeats until nothing fits."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOP_WORDS, col


def location_hints(place: Column | str) -> Column:
    """A place, its parts at commas, slashes and pipes, and their parts at hyphens, distinct and in order."""
    clean = F.trim(F.regexp_replace(col(place), "[–—]", "-"))
    parts = lambda c, by: F.filter(F.transform(F.split(c, by), lambda x: F.trim(x)), lambda p: p != "")
    whole = F.concat(F.array(clean), parts(clean, r"[,/|]"))
    finer = F.flatten(F.transform(whole, lambda w: parts(w, r"\s*-\s*")))
    return F.when(F.coalesce(clean, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(whole, finer)))


def _tokens(value: str) -> list[str]:
    return re.sub(r"[()\[\]{},/|\-–—]", " ", value).split()


def _key(token: str) -> str:
    return re.sub("[^a-z0-9]", "", "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c)))


def normalize_company(name: Column | str, hints: Column | str, aliases: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The name without trailing places of the hints, as often as one fits, unless only a generic word were left.

    aliases maps a canonical name to prefixes of compact names; it wins over stripping. Names without a fitting
    place keep their words and punctuation; blank and null names stay as they are.
    """
    rules = [(_key(p), canonical) for canonical, prefixes in (aliases or {}).items() for p in prefixes]

    def alias(tokens: list[str]) -> str | None:
        compact = _key("".join(tokens))
        return next((c for p, c in rules if p and compact.startswith(p)), None)

    def one(name: str | None, hints) -> str | None:
        if name is None or not name.split():
            return name
        tokens = _tokens(name)
        groups = sorted({tuple(map(_key, _tokens(h))) for h in (hints if hints is not None else []) if h and _tokens(h)}, key=lambda g: (-len(g), g))
        left = list(tokens)
        while fit := next((g for g in groups if 0 < len(g) < len(left) and tuple(map(_key, left[-len(g) :])) == g
                           and not (len(left) - len(g) == 1 and _key(left[0]) in STOP_WORDS)), None):
            left = left[: -len(fit)]
        plain = " ".join(left) if len(left) < len(tokens) else " ".join(name.split())
        return alias(left) or (alias(tokens) if len(left) == len(tokens) else None) or plain

    @F.pandas_udf("string")
    def run(names: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([one(n, p) for n, p in zip(names, places)], index=names.index, dtype=object)

    return run(col(name), col(hints))
