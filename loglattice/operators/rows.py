"""Operators on rows: fields, expressions, where, limit, total, timeslice and sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..functions.expressions import Compiler
from ..functions.values import DATE, Val, boolean, display, dyn, number, struct
from ..plans import nodes as n
from ..plans.state import By, State, col, slot


def fields(state: State, op: n.Fields) -> State:
    """Keep or drop fields. A row of which nothing is left goes."""
    if op.keep:
        kept = [x for x in (op.names if not state.table else state.fields) if x in state.fields and x in op.names]
    else:
        kept = [x for x in state.fields if x not in op.names]
    kept_fields = {x: state.fields[x] for x in dict.fromkeys(kept)}
    if any(k != "dyn" for k in kept_fields.values()):
        some = None
    else:
        some = reduce(Column.__or__, [col(x).isNotNull() for x in kept_fields], F.lit(False))
    gone = [slot(x) for x in state.fields if x not in kept_fields]
    df = state.df if some is None else state.df.where(some)
    if not state.table:  # the order of an aggregate may need them
        df = df.drop(*gone)
    return state.with_(df=df, fields=kept_fields)


def let(state: State, op: n.Let, compile_: Compiler) -> State:
    v = compile_(op.expr)
    state = compile_.state.failed(f"as {op.name}", lambda: compile_.why(op.expr))
    if v.kind == "dyn":
        out = state.put(op.name, v)
        return out.with_(df=out.df.where(col(op.name).isNotNull()))
    df = state.df if v.ok is None else state.df.where(v.ok)
    if v.kind == "none":
        return state.with_(df=df).put(op.name, Val("dyn", dyn(v)))
    return state.with_(df=df).put(op.name, Val(v.kind, v.col))


def where(state: State, op: n.Where, compile_: Compiler) -> State:
    if op.test is None:
        raise PlanError("where takes a condition", compile_.text, op.at)
    v = compile_(op.test)
    state = compile_.state
    if isinstance(op.test, n.Literal) and v.kind != "bool":
        raise PlanError(f"where takes a condition, not {op.test.text}", compile_.text, op.test.at, op.test.at + len(op.test.text))
    test = boolean(v)
    state = state.failed("where", lambda: F.coalesce(compile_.why(op.test), F.when(test.isNull(), F.concat(F.lit("Expected boolean, found "), F.coalesce(display(v), F.lit("None"))))))
    plain = compile_.plain(op.test)
    return state.with_(df=state.df.where(test if plain is None else plain))


def limit(state: State, op: n.Limit, compile_: Compiler) -> State:
    if op.count == 0 or op.count != int(op.count):
        raise PlanError(f"a limit is a whole number other than 0, not {op.count:g}", compile_.text, op.at)
    k = int(op.count)
    order = state.order
    if not order or state.natural and k > 0:  # partitions are read from the first on, until there are enough rows
        return state.with_(df=state.df.limit(abs(k)))
    return state.with_(df=state.df.orderBy(*(o.column(reverse=k < 0) for o in order)).limit(abs(k)))


def total(state: State, op: n.Total, compile_: Compiler) -> State:
    """The running sum in the order of the rows; what is no number counts as 0 and stays.

    Where one column of numbers gives the order, rows are cut into ranges by splitters, which a job finds while the
    query is planned; where it is the place in files, by the splits of the files. Each range sums its own rows, and what
    comes before a range is added to it. No task sees all rows. Over other orders one does.
    """
    x = F.coalesce(number(compile_(op.of), dates=False), F.lit(0.0))
    state = compile_.state
    source = "_total_in"
    df = state.df.withColumn(source, x)
    before, order = Window.unboundedPreceding, [o.column() for o in state.order]
    simple = not state.table and len(state.order) == 1 and not state.df.isStreaming
    if not state.order:
        raise PlanError("total needs an order of the rows")
    if simple and state.options.order_column:
        key = F.col(state.options.order_column)
        cuts = df.select(F.percentile_approx(key, [k / 64 for k in range(1, 64)], 10_000)).first()[0] or []
        cuts = sorted(set(cuts))
        bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < key)) if cuts else F.lit(0)
        df = df.withColumn("_bucket", bucket)
        each = df.groupBy("_bucket").agg(F.sum(source).alias("_sum"))
        base = each.select("_bucket", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(before, -1)), F.lit(0.0)).alias("_base"))
        df = df.join(F.broadcast(base), "_bucket")  # 64 rows at most
        run = F.sum(source).over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(before, 0)) + F.col("_base")
        df = df.withColumn("_run", run).drop("_bucket", "_base")
    elif simple and "_ord" in df.columns and isinstance(df.schema["_ord"].dataType, T.StructType):
        # lines of files: each split sums its own
        split = F.struct(F.col("_ord.file").alias("file"), F.col("_ord.block").alias("block"))
        each = df.groupBy(split.alias("_split")).agg(F.sum(source).alias("_sum"))
        base = each.select("_split", F.coalesce(F.sum("_sum").over(Window.orderBy("_split").rowsBetween(before, -1)), F.lit(0.0)).alias("_base"))
        df = df.withColumn("_split", split).join(base, "_split")
        run = F.sum(source).over(Window.partitionBy("_split").orderBy(*order).rowsBetween(before, 0)) + F.col("_base")
        df = df.withColumn("_run", run).drop("_split", "_base")
    else:
        df = df.withColumn("_run", F.sum(source).over(Window.orderBy(*order).rowsBetween(before, 0)))
    out = state.with_(df=df).put(op.name, Val("float", F.col("_run")))
    return out.with_(df=out.df.drop("_run", source))


def timeslice(state: State, op: n.Timeslice, compile_: Compiler) -> State:
    if op.step is None:
        raise PlanError("timeslice takes a duration, such as 5m", compile_.text, op.at)
    if op.step % 1000 or op.step == 0:
        raise PlanError("a slice is a whole number of microseconds", compile_.text, op.at)
    v = compile_(op.of)
    state = compile_.state
    micros = F.unix_micros(v.guarded()) if v.kind == "date" else F.when(v.col.r == DATE, v.col.i) if v.kind == "dyn" else F.lit(None).cast("bigint")
    step = F.lit(op.step // 1000).cast("bigint")
    floor = F.timestamp_micros(micros - F.pmod(micros, step))

    def why() -> Column:
        hint = F.concat(F.lit("Expected date, found '"), F.coalesce(display(v), F.lit("None")), F.lit("'.  Use parseDate() to convert a value to a date"))
        return F.coalesce(compile_.why(op.of), F.when(micros.isNull(), hint))

    state = state.failed("timeslice", why)
    df = state.df.where(micros.isNotNull())
    return state.with_(df=df).put(op.name, Val("date", floor))


def sort_key(v: Val, descending: bool) -> By:
    """A missing value comes last either way; an explicit None is the least."""
    if v.kind == "dyn" or v.kind == "none" or v.ok is not None:
        return By(dyn(v), descending, True)
    return By(v.col, descending, descending)


def sort(state: State, op: n.Sort, compile_: Compiler) -> State:
    keys = []
    for k, e in enumerate(op.keys):
        v = compile_(e)
        df = compile_.state.df
        if not (isinstance(e, n.Ref) and not e.path):
            name = f"_sort{k}"
            while name in df.columns:
                name += "_"
            df = df.withColumn(name, dyn(v))
            compile_.state = compile_.state.with_(df=df)
            v = Val("dyn", F.col(name))
        keys.append(sort_key(v, op.descending))
    plain = {e.name for e in op.keys if isinstance(e, n.Ref) and not e.path}
    rest = [sort_key(Val(k, col(x)), op.descending and not op.keys) for x, k in state.fields.items() if x not in plain]
    return compile_.state.with_(order=tuple(keys + rest), natural=False, raw=None)


__all__ = ["fields", "let", "where", "limit", "total", "timeslice", "sort", "sort_key", "struct"]
