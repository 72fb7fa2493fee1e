"""The search in front of a pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import keyword, literal, wildcard
from ..plans import nodes as n


def matches(search, raw: Column) -> Column | None:
    """Whether a line passes; None if all do."""
    if isinstance(search, n.Keyword):
        plain = literal(search.text)
        if plain is not None:
            return F.contains(F.lower(raw), F.lit(plain))
        return raw.rlike(wildcard(search.text)[0] if search.wildcard else keyword(search.text))
    if isinstance(search, n.None_):
        inner = matches(search.of, raw)
        return F.lit(False) if inner is None else ~inner
    parts = [matches(s, raw) for s in search.of]
    if isinstance(search, n.Any_):
        return None if any(p is None for p in parts) else reduce(Column.__or__, parts)
    parts = [p for p in parts if p is not None]
    return reduce(Column.__and__, parts) if parts else None
