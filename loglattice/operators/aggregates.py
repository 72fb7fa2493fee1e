"""Aggregates, with group keys that are any expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import Compiler
from ..functions.values import Val, boolean, dyn, none, number
from ..plans import nodes as n
from ..plans.state import By, State, col, slot


def _one(op: n.Agg, compile_: Compiler, exact: bool, here: Column | None = None) -> tuple[str, Column]:
    """(kind, aggregate). ``here``: the rows that it is of."""

    def only(c: Column) -> Column:
        return c if here is None else F.when(here, c)

    if op.func == "count":
        return "int", F.count(only(F.lit(1))) if op.arg is None else F.count_if(F.coalesce(only(boolean(compile_(op.arg))), F.lit(False)))
    v = compile_(op.arg)
    if op.func == "count_distinct" and compile_.state.df.isStreaming:
        return "int", F.size(F.collect_set(dyn(v))).cast("bigint")
    if op.func == "count_distinct":
        if v.kind in ("dyn", "none"):
            return "int", F.count_distinct(only(dyn(v)))
        # a null of a known kind is an explicit None, and counts once
        some_none = F.coalesce(F.max(only((v.col.isNull() & v.good()).cast("int"))), F.lit(0))
        return "int", (F.count_distinct(only(v.guarded())) + some_none).cast("bigint")
    x = only(number(v, dates=False))
    finite = F.when(~F.isnan(x), x)
    if op.func == "sum":
        return "float", F.coalesce(F.sum(x), F.lit(0.0))
    if op.func == "avg":
        return "float", F.coalesce(F.avg(x), F.lit(float("nan")))
    if op.func in ("min", "max"):
        best = (F.min if op.func == "min" else F.max)(finite)
        return "float", F.when(F.abs(best) < float("inf"), best)
    if exact:
        return "float", _exact(x, op.share)
    return "float", F.percentile_approx(x, op.share, 10_000).cast("double")


def _exact(x: Column, share: float) -> Column:
    """The element of rank ⌈share·n⌉, from all values of the group."""
    values = F.sort_array(F.collect_list(x))
    rank = F.greatest(F.ceil(F.round(F.lit(share) * F.size(values), 9)).cast("int"), F.lit(1))
    return F.try_element_at(values, rank)


#: Ranges of values in each power of 2, which are sorted apart, and values in a piece of a range.
RANGES, PIECE = 16, 4096


def _range(x: Column) -> Column:
    """A whole number that never falls as x rises: the place of its logarithm, by sign."""
    place = F.floor(F.signum(x) * (F.log2(F.abs(x)) + 1075) * RANGES)
    return F.when(F.isnan(x) | (x == float("inf")), 1 << 20).when(x == float("-inf"), -(1 << 20)).when(x == 0, 0).otherwise(place)


def _ranked(df: DataFrame, keys: dict[str, Column], aggs: dict[str, Column], values: list[Column], shares: dict[str, tuple[int, float]]) -> DataFrame:
    """Aggregates of which some are percentiles: the elements of rank ⌈share·n⌉, in one pass over the rows.

    Equal values are counted, then each range of values is sorted by itself and cut into pieces, and only the pieces of
    a group come together in one task. Rows with the number 0 are for the other aggregates, and those with j for
    ``values[j - 1]``. ``shares`` has (j, share) for each percentile.
    """
    kept = {f"_key{k}": c for k, c in enumerate(keys.values())}
    each = [F.struct(F.lit(j).alias("j"), x.alias("x")) for j, x in enumerate([F.lit(None).cast("double"), *values]) if j or aggs]
    df = df.withColumns(kept | {"_of": F.explode(F.array(*each)) if len(each) > 1 else each[0]})
    df = df.select("*", F.col("_of.j").alias("_j"), F.col("_of.x").alias("_x"))
    counted = df.groupBy(*kept, "_j", "_x").agg(F.count("_x").alias("_n"), *(c.alias(k) for k, c in aggs.items()))
    counted = counted.withColumn("_range", _range(F.col("_x")))
    place = F.row_number().over(Window.partitionBy(*kept, "_j", "_range").orderBy("_x"))
    pieces = counted.withColumn("_piece", F.floor((place - 1) / PIECE)).groupBy(*kept, "_j", "_range", "_piece")
    pieces = pieces.agg(F.sum("_n").alias("_n"), F.collect_list(F.struct("_x", "_n")).alias("_xs"), *(F.max(f"`{k}`").alias(k) for k in aggs))
    group = Window.partitionBy(*kept, "_j")
    upto, n_all = F.sum("_n").over(group.orderBy("_range", "_piece").rowsBetween(Window.unboundedPreceding, 0)), F.sum("_n").over(group)
    pieces = pieces.withColumns({"_upto": upto, "_all": n_all})
    out = [F.max(F.when(F.col("_j") == 0, F.col(f"`{k}`"))).alias(k) for k in aggs]
    for k, (j, share) in shares.items():
        rank = F.ceil(F.col("_all").cast("decimal(20,0)") * F.lit(Decimal(f"{Decimal(repr(share)):f}"))).cast("bigint")
        rest = rank - F.col("_upto") + F.col("_n")
        here = (F.col("_j") == j) & (rest > 0) & (rest <= F.col("_n"))
        out.append(F.max(F.when(here, _at(F.col("_xs"), rest))).alias(k))
    if not kept:
        return pieces.agg(*out, F.count(F.lit(1)).alias("_rows")).where("_rows > 0").drop("_rows")
    return pieces.groupBy(*(F.col(c).alias(k) for c, k in zip(kept, keys))).agg(*out)


def _at(counts: Column, rank: Column) -> Column:
    """The element of a rank among values with their counts."""
    start = F.struct(rank.alias("left"), F.lit(None).cast("double").alias("x"))

    def step(seen: Column, c: Column) -> Column:
        return F.struct((seen.left - c._n).alias("left"), F.when(seen.left > 0, c._x).otherwise(seen.x).alias("x"))

    return F.aggregate(F.sort_array(counts), start, step, lambda seen: seen.x)


def names_of(op: n.Aggregate) -> tuple[list[str], list[str]]:
    """Fields of the keys and of the aggregates; a name that is taken gets a number."""
    keys = [e.name if isinstance(e, n.Ref) and not e.path else e.text for e in op.keys]
    taken, out = set(keys), []
    for a in op.aggs:
        name, k = a.name, 2
        while name in taken:
            name, k = f"{a.name}_{k}", k + 1
        taken.add(name)
        out.append(name)
    return keys, out


def aggregate(state: State, op: n.Aggregate, compile_: Compiler) -> State:
    """One row for each group; a key that is missing or an error becomes None. Nothing comes of no rows."""
    keys, names = names_of(op)
    grouped, kinds = {}, {}
    for name, e in zip(keys, op.keys):
        v = compile_(e)
        if v.kind in ("dyn", "none"):
            grouped[name], kinds[name] = F.coalesce(dyn(v), none()), "dyn"
        else:
            grouped[name], kinds[name] = v.guarded(), v.kind
    # a stream can't be sorted within its groups
    ranked = [a.arg for a in op.aggs if a.func == "percentile" and not state.df.isStreaming]
    ranked = [e for k, e in enumerate(ranked) if e not in ranked[:k]]
    values, shares = [number(compile_(e), dates=False) for e in ranked], {}
    aggs = {}
    for name, a in zip(names, op.aggs):
        if a.func == "percentile" and ranked:
            kinds[name], shares[slot(name)] = "float", (ranked.index(a.arg) + 1, a.share)
        else:
            kinds[name], aggs[name] = _one(a, compile_, state.options.exact_percentiles, F.col("_j") == 0 if ranked else None)
    state = compile_.state
    out = [c.alias(slot(k)) for k, c in aggs.items()]
    if ranked:
        df = _ranked(state.df, {slot(k): c for k, c in grouped.items()}, {slot(k): c for k, c in aggs.items()}, values, shares)
    elif grouped:
        df = state.df.groupBy(*(c.alias(slot(k)) for k, c in grouped.items())).agg(*out)
    else:
        df = state.df.agg(*out, F.count(F.lit(1)).alias("_rows")).where("_rows > 0").drop("_rows")
    # rows have no order until they are sorted; this one is the implicit one
    ascending = any(isinstance(e, n.Ref) and not e.path and e.name == "_timeslice" for e in op.keys)
    first = ["_timeslice", *names] if ascending else names
    order = [By(col(x), not ascending, not ascending or kinds[x] == "dyn") for x in first]
    order += [By(col(x), False, kinds[x] == "dyn") for x in keys if x not in first]
    return state.with_(df=df, fields=kinds, order=tuple(order), natural=False, table=True, raw=None, variants={}, narrow={})


__all__ = ["aggregate", "names_of", "Val"]
