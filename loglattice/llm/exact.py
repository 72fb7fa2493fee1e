"""Exact deduplication by content sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, columns, fresh


def normalised(text):
    """Runs of blanks, tabs and line ends become one blank; blanks at either end go."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))


def _sorted(docs: DataFrame, id_col: str, text_col: str, carry: bool, prefix_chars: int):
    """``docs`` with columns (first, rank, body): the smallest id of the same content, and the rank of the row in it.

    Sampled splitters range-partition the rows by the first characters of the normalised text and, where these are
    the same in many documents, by its hash. The sample that reaches the driver thus holds short keys, never texts.
    Equal contents land in one partition; its external sort compares whole normalised texts and puts equals next to
    each other, smallest id first, and the window compares each row with its neighbour in full. Rows without text
    are spread by their id.
    """
    body, head, tail, first, rank = (fresh(docs, f"_{n}") for n in ("body", "head", "tail", "first", "rank"))
    text = column(text_col)
    norm = normalised(text)
    if not carry:
        docs = docs.select(column(id_col), norm.alias(body))
        norm = column(body)
    keyed = docs.withColumns({
        head: F.substring(norm, 1, prefix_chars),
        tail: F.when(norm.isNull(), F.xxhash64(column(id_col))).otherwise(F.xxhash64(norm)),
    })
    placed = keyed.repartitionByRange(column(head), column(tail))
    if carry:
        placed = placed.withColumn(body, normalised(text))
    same = Window.partitionBy(column(head), column(tail), column(body)).orderBy(column(id_col).asc_nulls_last())
    marked = placed.withColumns({rank: F.row_number().over(same), first: F.first(column(id_col)).over(same)})
    return marked, body, first, rank


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 32) -> DataFrame:
    """(id, duplicate_of): each document whose normalised text an earlier one has, with the smallest such id.

    Null texts equal nothing. Empty texts, and texts of blanks only, equal each other. A row repeated with its id is
    reported as a duplicate of that id. Null ids come last and so are never retained over others.
    """
    marked, body, first, rank = _sorted(docs, id_col, text_col, False, prefix_chars)
    twins = marked.where((column(rank) > 1) & column(body).isNotNull())
    return twins.select(column(id_col), column(first).alias("duplicate_of"))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 32) -> DataFrame:
    """``docs`` without the rows that :func:`exact_duplicates` reports; all columns, one shuffle."""
    marked, body, _, rank = _sorted(docs, id_col, text_col, True, prefix_chars)
    return marked.where((column(rank) == 1) | column(body).isNull()).select(*columns(docs.columns))


EXACT_SQL = """
SELECT doc_id, duplicate_of FROM (
  SELECT doc_id, row_number() OVER w AS rank, first_value(doc_id) OVER w AS duplicate_of
  FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS body FROM documents WHERE text IS NOT NULL)
  WINDOW w AS (PARTITION BY body ORDER BY doc_id)
) WHERE rank > 1
"""
