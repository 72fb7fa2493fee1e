"""Any DataFrame: its columns are fields, and one of them, or all as JSON, the line."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.state import By, State, col, lifted, native, slot


def state(df: DataFrame, options, raw: str | None = None, order_by: str | list[str] | None = None) -> State:
    """``raw`` names the column to search and parse; without it that is the row as JSON. ``order_by`` gives the
    stream's order; without it rows come in the order of their partitions.
    """
    kinds = native(df)
    columns = [lifted(df, name, kind).alias(slot(name)) for name, kind in kinds.items()]
    line = F.to_json(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))) if raw is None else F.col(f"`{raw}`").cast("string")
    extra = [line.alias("_raw")]
    # a scan skips data by null only where it isn't asked of a cast
    narrow = {c: f"_narrow{k}" for k, (c, t) in enumerate(df.dtypes) if t in ("tinyint", "smallint", "int")}
    extra += [F.col(f"`{c.replace('`', '``')}`").alias(x) for c, x in narrow.items()]
    names = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if not names and not df.isStreaming:
        extra.append(F.monotonically_increasing_id().alias("_ord"))
        order = (By(F.col("_ord")),)
    else:
        order = tuple(By(F.col(f"_ord{k}"), False, False) for k in range(len(names)))
        extra += [F.col(f"`{x}`").alias(f"_ord{k}") for k, x in enumerate(names)]
    numeric = len(names) == 1 and kinds[names[0]] in ("int", "float")
    return State(df.select(*columns, *extra), kinds, "_raw", order, options=replace(options, order_column="_ord0" if numeric else None), natural=not names and not df.isStreaming, narrow=narrow)


__all__ = ["state", "col"]
