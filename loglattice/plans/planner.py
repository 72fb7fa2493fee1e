"""From a syntax tree to a plan state: aliases are spliced in, then each operator is applied in turn."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.expressions import Compiler
from ..operators import aggregates, parsers, rows
from ..operators.search import matches
from . import nodes as n
from .grammar import Parser
from .state import State


@dataclass(frozen=True)
class Options:
    """``schema``: fields of JSON, as DDL or a StructType; known fields are read straight into typed columns.
    ``exact_percentiles``: those of a stream by all values of a group and not by a sketch; those of a table always are exact. ``compat_sort_order``: an operator on rows that
    is written behind a sort of records comes before it. ``order_column``: a hidden column that numbers the rows.
    """

    schema: object = None
    exact_percentiles: bool = False
    compat_sort_order: bool = False
    order_column: str | None = None
    functions: dict = field(default_factory=dict)
    aliases: dict = field(default_factory=dict)


def spliced(ops: tuple, aliases: dict[str, str], seen: tuple = ()) -> list:
    out = []
    for op in ops:
        if isinstance(op, n.Alias):
            if op.name in seen:
                raise PlanError(f"alias '{op.name}' contains itself")
            out += spliced(Parser(aliases[op.name], aliases).operators(), aliases, (*seen, op.name))
        else:
            out.append(op)
    return out


def needed_after(ops: list, at: int) -> set[str] | None:
    """Fields that later operators read, if nothing else is shown in the end; None if all are."""
    names: set[str] = set()
    for op in ops[at + 1 :]:
        if isinstance(op, n.Aggregate):
            return names | n.refs(op)
        if isinstance(op, n.Fields) and op.keep:
            return names | set(op.names)
        if isinstance(op, n.Sort) and not op.keys:
            return None
        if not isinstance(op, n.Fields):
            names |= n.refs(op)
    return None


def in_order(ops: list, compat: bool) -> list:
    """With ``compat``, operators on single rows go before the sort of records that they are written behind."""
    if not compat:
        return ops
    out = list(ops)
    inline = (n.Json, n.Logfmt, n.Parse, n.Split, n.Fields, n.Where, n.Limit, n.Total, n.Timeslice, n.Let)
    for k in range(1, len(out)):
        j = k
        while j > 0 and isinstance(out[j], inline) and isinstance(out[j - 1], n.Sort) and not any(isinstance(x, n.Aggregate) for x in out[:j]):
            out[j - 1], out[j] = out[j], out[j - 1]
            j -= 1
    return out


def start(query: n.Query, state: State) -> State:
    test = matches(query.search, F.col(state.raw)) if state.raw else None
    return state if test is None else state.with_(df=state.df.where(test))


def apply(state: State, op, ops: list, at: int) -> State:
    compile_ = Compiler(state)
    kind = type(op)
    if kind in (n.Json, n.Logfmt, n.Parse):
        wanted = needed_after(ops, at)
        return getattr(parsers, kind.__name__.lower())(state, op, compile_, wanted)
    if kind is n.Split:
        return parsers.split(state, op, compile_)
    if kind is n.Fields:
        return rows.fields(state, op)
    if kind is n.Aggregate:
        return aggregates.aggregate(state, op, compile_)
    return getattr(rows, kind.__name__.lower())(state, op, compile_)


def plan(text: str, state: State, until_aggregate: bool = False) -> tuple[State, list]:
    """(state, operators left): all operators, or those up to the first aggregate with it."""
    query = Parser(text, state.options.aliases).query()
    ops = in_order(spliced(query.operators, state.options.aliases), state.options.compat_sort_order)
    state = start(query, state.with_(text=text))
    for k, op in enumerate(ops):
        state = apply(state, op, ops, k)
        if until_aggregate and isinstance(op, n.Aggregate):
            return state, ops[k + 1 :]
    return state, []


def resume(state: State, ops: list) -> State:
    for k, op in enumerate(ops):
        state = apply(state, op, ops, k)
    return state
