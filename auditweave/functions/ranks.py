"""Rank and lookup expressions over literal tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(entries: dict) -> Column:
    """A constant map column; folded once by the optimiser."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])


def lookup(key: Column, entries: dict) -> Column:
    """Value of ``key`` in a constant table, null when absent."""
    return F.try_element_at(literal_map(entries), key)


def rank_of(label: Column, ordered: list[str], missing: int) -> Column:
    """Position of a label in its rank order, never alphabetical."""
    return F.coalesce(lookup(label, {name: i for i, name in enumerate(ordered)}), F.lit(missing))


def any_word_in(haystack: Column, words: list[str]) -> Column:
    """True when any word is a substring (not a whole word)."""
    result = F.lit(False)
    for word in words:
        result = result | haystack.contains(word)
    return result
