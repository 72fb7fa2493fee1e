"""Operators that make fields of text: json, logfmt, parse and split."""

from __future__ import annotations

import json as jsonlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..functions.expressions import Compiler
from ..functions.patterns import MARK, numbered, wildcard
from ..functions.values import ARRAY, DYN, null, OBJECT, Val, display, dyn, from_variant, let, none, struct, trimmed, typed
from ..plans import nodes as n
from ..plans.state import State, native


def _source(state: State, node, compile_: Compiler) -> Column:
    """The text an operator reads; null where there is none."""
    return display(compile_(node)) if node is not None else state.raw_text().guarded()


def _no_source(state: State, operator: str, node, compile_: Compiler) -> State:
    return state if node is None else state.failed(operator, lambda: compile_.why(node))


def once(c: Column) -> Column:
    """The column, so marked that the optimizer neither computes it again for each use nor moves filters below it."""
    return F.when(F.rand() < 2, c)


def _hidden(state: State, name: str) -> str:
    k = 0
    while f"_{name}{k}" in state.df.columns:
        k += 1
    return f"_{name}{k}"


def _discover(state: State, keys: Column) -> list[str]:
    """All keys there are: a pass over the data, needed only where every field is to be shown."""
    if state.df.isStreaming:
        raise PlanError("on a stream the fields must be named: end with an aggregate or 'fields', or give a schema")
    return sorted(r[0] for r in state.df.select(F.explode(keys)).distinct().collect())


def json(state: State, op: n.Json, compile_: Compiler, needed: set[str] | None) -> State:
    text = _source(state, op.source, compile_)
    state = _no_source(compile_.state, "json", op.source, compile_)
    state = state.failed("json", lambda: F.when(text.isNotNull() & F.try_parse_json(text).isNull(), F.concat(F.lit("Expected JSON, found "), text)))
    schema = state.options.schema
    if schema is not None:
        row, ok = _hidden(state, "row"), _hidden(state, "ok")
        df = state.df.withColumns({row: F.from_json(text, schema), ok: F.try_parse_json(text).isNotNull()}).where(F.col(ok))
        state = state.with_(df=df)
        part = df.select(f"{row}.*")
        for f in T._parse_datatype_string(schema) if isinstance(schema, str) else schema:
            if needed is None or f.name in needed:
                kind = native(part.select(f"`{f.name}`"))[f.name]
                c = F.col(row)[f.name]
                if kind == "dyn":
                    nested = F.to_json(c, {"ignoreNullFields": "false"})
                    v = Val("dyn", F.when(c.isNotNull(), struct(ARRAY if isinstance(f.dataType, T.ArrayType) else OBJECT, s=nested)))
                else:
                    cast = {"int": "bigint", "float": "double", "date": "timestamp"}.get(kind)
                    v = Val(kind, c.cast(cast) if cast else c, c.isNotNull())
                state = state.put(f.name, v, keep_old=f.name in state.fields)
        return state
    v = _hidden(state, "json")
    df = state.df.where(text.isNotNull()).withColumn(v, once(F.try_parse_json(text))).where(F.col(v).isNotNull())
    state = state.with_(df=df)
    if needed is None:
        needed = set(_discover(state, F.map_keys(F.try_variant_get(F.col(v), "$", "map<string,variant>"))))
    for name in sorted(needed):
        if "'" in name and '"' in name:
            raise PlanError(f"a key with both kinds of quotes can't be read: {name}")
        q = '"' if "'" in name else "'"
        x = F.try_variant_get(F.col(v), f"$[{q}{name}{q}]", "variant")
        new = name not in state.fields
        state = state.put(name, Val("dyn", from_variant(x)), keep_old=not new)
        if new:
            state = state.with_(variants=state.variants | {name: (v, name)})
    return state


_PAIR = r"""([^\s=\"]+)(=(?:"((?:[^"\\]|\\.)*)"|(\S*)))?"""


def logfmt(state: State, op: n.Logfmt, compile_: Compiler, needed: set[str] | None) -> State:
    text = compile_.bind(_source(state, op.source, compile_))
    state = _no_source(compile_.state, "logfmt", op.source, compile_)
    pairs, keys = _hidden(state, "pairs"), _hidden(state, "keys")
    # the last of several pairs of a key counts, so they are turned round
    found = F.reverse(F.regexp_extract_all(text, F.lit(_PAIR), F.lit(0)))
    df = state.df.where(text.isNotNull()).withColumn(pairs, once(found))
    df = df.withColumn(keys, once(F.transform(F.col(pairs), lambda p: F.substring_index(p, "=", 1))))
    state = state.with_(df=df)
    if needed is None:
        needed = set(_discover(state, F.col(keys)))
    for name in sorted(needed):
        at, value = _hidden(state, "at"), _hidden(state, "value")
        here = F.array_position(F.col(keys), F.lit(name)).cast("int")
        pair = F.substring(F.get(F.col(pairs), F.col(at) - 1), len(name) + 2, 2**31 - 1)
        state = state.with_(df=state.df.withColumn(at, once(here)).withColumn(value, once(pair)))
        v = F.col(value)
        bare = F.length(F.get(F.col(pairs), F.col(at) - 1)) == len(name)
        quoted = v.startswith('"') & v.endswith('"') & (F.length(v) > 1)
        inner = F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1")
        made = once(F.when(F.col(at) == 0, null().cast(DYN)).when(bare, none()).otherwise(typed(F.when(quoted, inner).otherwise(v))))
        state = state.put(name, Val("dyn", made), keep_old=name in state.fields)
        state = state.with_(df=state.df.drop(at, value))
    return state.with_(df=state.df.drop(pairs, keys))


def parse(state: State, op: n.Parse, compile_: Compiler, needed: set[str] | None) -> State:
    text = compile_.bind(trimmed(_source(state, op.source, compile_)))
    state = _no_source(compile_.state, "parse", op.source, compile_)
    got = _hidden(state, "parse")
    if op.regex:
        try:
            re.compile(op.pattern)
        except re.error as e:
            raise PlanError(f"not a regular expression: {e}", compile_.text, op.at) from None
        regex, names, optional, unnamed = numbered(op.pattern)
        if unnamed:
            raise PlanError("all groups need names", compile_.text, op.at, help="write (?P<name>...)")
        if not names:
            raise PlanError("the pattern has no groups", compile_.text, op.at)
    else:
        regex, count = wildcard(op.pattern)
        names, optional = list(op.names), False
        if count != len(names):
            raise PlanError(f"the pattern has {count} wildcards for {len(names)} fields", compile_.text, op.at)
    if optional:
        values = _python_groups(op.pattern)(text)
        hit = F.col(got).isNotNull()
    else:
        # one pass: all captures as one string with marks between, cut at the marks
        joined = MARK.join(f"${k + 1}" for k in range(len(names)))
        start = regex.index(")") + 1
        all_ = regex[:start] + r"\A(?s:.*?)" + regex[start:].removesuffix(r"\z") + (r"\z" if regex.endswith(r"\z") else r"(?s:.*)\z")
        values = F.when(text.rlike(regex), F.split(F.regexp_replace(text, all_, joined), MARK))
        hit = F.col(got).isNotNull()
    state = state.with_(df=state.df.withColumn(got, values))
    if not op.nodrop:
        state = state.with_(df=state.df.where(hit))
    for k, name in enumerate(names):
        if needed is not None and name not in needed:
            continue
        piece = F.col(got)[k]
        if op.noconvert:
            found = F.when(piece.isNotNull(), struct(3, s=piece))
        else:
            found = typed(piece)
        if op.nodrop:
            old = dyn(Val(state.fields[name], _col(name))) if name in state.fields else none()
            v = Val("dyn", F.when(hit, F.coalesce(found, none())).otherwise(F.coalesce(old, none())))
        elif optional:
            v = Val("dyn", F.coalesce(found, none()))
        else:
            v = Val("str", piece) if op.noconvert else Val("dyn", found)
        state = state.put(name, v)
    return state


def _col(name: str) -> Column:
    from ..plans.state import col

    return col(name)


def _python_groups(pattern: str):
    """Groups that may take no part can't be told from empty ones by Spark's functions."""
    compiled = re.compile(re.sub(r"\(\?<([A-Za-z_])", r"(?P<\1", pattern))

    @F.pandas_udf("array<string>")
    def groups(s: pd.Series) -> pd.Series:
        found = (None if x is None else compiled.search(x) for x in s)
        return pd.Series([None if m is None else [m.group(g) for g in compiled.groupindex] for m in found])

    return groups.asNondeterministic()  # or it would be computed again in a filter below


def split(state: State, op: n.Split, compile_: Compiler) -> State:
    if op.source is None:
        text, to = state.raw_text().guarded(), op.to or n.Ref("_split")
    else:
        v = compile_(op.source)
        text = v.guarded() if v.kind == "str" else F.when(v.col.r == 3, v.col.s) if v.kind == "dyn" else null().cast("string")
        to = op.to or (op.source if isinstance(op.source, n.Ref) else n.Ref("_split"))
    text = compile_.bind(text)
    state = compile_.state
    if op.source is not None:
        state = state.failed("split", lambda: F.coalesce(compile_.why(op.source), F.when(text.isNull(), F.concat(F.lit("Expected string, found "), F.coalesce(display(v), F.lit("None"))))))
    sep = "".join(c if c.isalnum() else "\\" + c if c.isprintable() and ord(c) < 128 else f"\\x{{{ord(c):X}}}" for c in op.separator)
    # a token is what quotes enclose, all behind a quote that isn't closed, or what comes before the next separator
    token = rf"""\G(?:"(?:\\"|[^"])*"|'(?:\\'|[^'])*'|["'](?s:.)+|(?!["'])(?:(?!{sep})(?s:.))+(?:{sep})?|{sep})"""
    strip = rf"{sep}\z"

    def bare(t: Column) -> Column:
        closed = (F.length(t) > 1) & ((t.startswith('"') & t.endswith('"')) | (t.startswith("'") & t.endswith("'")))
        open_ = t.startswith('"') | t.startswith("'")
        return trimmed(F.when(closed, F.substring(t, F.lit(2), F.length(t) - 2)).when(open_, t).otherwise(F.regexp_replace(t, strip, "")))

    def item(t: Column) -> Column:
        return let(typed(t), variant_of)

    def variant_of(d: Column) -> Column:
        return F.when(d.r == 2, F.when(d.i.isNotNull(), d.i.cast("variant")).otherwise(d.n.cast("variant"))).when(d.r == 1, (d.n == 1).cast("variant")).otherwise(d.s.cast("variant"))

    tokens = F.filter(F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(0)), bare), lambda t: t != "")
    array = F.to_json(F.transform(tokens, item))
    keep = text.isNotNull()
    if not to.path:
        return state.with_(df=state.df.where(keep)).put(to.name, Val("dyn", struct(ARRAY, s=array)))
    if to.name not in state.fields:
        return state.with_(df=state.df.where(F.lit(False)))
    old = dyn(Val(state.fields[to.name], _col(to.name)))
    new = _python_put(to.path)(F.when(old.r >= ARRAY, old.s), array)
    hidden = _hidden(state, "put")
    state = state.with_(df=state.df.where(keep).withColumn(hidden, new).where(F.col(hidden).isNotNull()))
    return state.put(to.name, Val("dyn", struct_like(old, F.col(hidden))))


def struct_like(old: Column, text: Column) -> Column:
    return F.when(old.r == ARRAY, struct(ARRAY, s=text)).otherwise(struct(OBJECT, s=text))


def _python_put(path: tuple):
    """A value written into JSON at a path; null where the way there is of another kind."""

    @F.pandas_udf("string")
    def put(old: pd.Series, value: pd.Series) -> pd.Series:
        out = []
        for o, v in zip(old, value):
            try:
                root = jsonlib.loads(o)
                at = root
                for k, step in enumerate(path):
                    if isinstance(step, int) != isinstance(at, list):
                        raise TypeError
                    if isinstance(step, int) and not -len(at) <= step < len(at):
                        raise IndexError
                    if k == len(path) - 1:
                        at[step] = jsonlib.loads(v)
                    elif isinstance(step, str) and step not in at:
                        at[step] = {}
                        at = at[step]
                    else:
                        at = at[step]
                out.append(jsonlib.dumps(root, ensure_ascii=False))
            except (TypeError, IndexError, ValueError):
                out.append(None)
        return pd.Series(out)

    return put.asNondeterministic()
