"""Arithmetic, order and equality of dynamic values against a small evaluator."""

import json
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from loglattice.session import Engine
from loglattice.sinks import render

scalars = st.one_of(st.none(), st.booleans(), st.integers(-(10**6), 10**6), st.floats(-1e6, 1e6).map(lambda x: round(x, 3)), st.sampled_from(["", "a", "b", "12", "1,5", "x9", "1.2.3"]))
RANK = {type(None): 0, bool: 1, int: 2, float: 2, str: 3}


def collapse(x):
    return int(x) if isinstance(x, float) and math.isfinite(x) and x == math.floor(x) else x


def number(v):
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, str):
        kept = "".join(c for c in v if c.isdigit() or c == ".")
        return float(kept) if kept.count(".") < 2 and kept.strip(".") else None
    return v


def less(a, b):
    a, b = collapse(a), collapse(b)
    return RANK[type(a)] < RANK[type(b)] if RANK[type(a)] != RANK[type(b)] else a is not None and a < b


def equal(a, b):
    a, b = collapse(a), collapse(b)
    return type(a) is type(b) and a == b


def plus(a, b):
    x, y = number(a), number(b)
    return None if x is None or y is None else x + y


@settings(max_examples=2, deadline=None)
@given(st.lists(st.tuples(scalars, scalars), min_size=30, max_size=60))
def test_pairs(spark, pairs):
    engine = Engine(spark)
    lines = [json.dumps({"i": k, "a": a, "b": b}) for k, (a, b) in enumerate(pairs)]
    got = {}
    for names, query in ((("lt", "ge", "eq"), "a < b as lt | a >= b as ge | a == b as eq | fields i, lt, ge, eq"), (("plus",), "a + b as plus | fields i, plus")):
        found = list(render.rows(engine.query_lines(f"* | json | {query}", lines)))
        for name in names:
            got[name] = {v["i"].value: v[name].value for v, _ in found}
    for k, (a, b) in enumerate(pairs):
        assert got["lt"][k] == less(a, b) and got["ge"][k] == (not less(a, b)) and got["eq"][k] == equal(a, b)
        want = plus(a, b)
        assert (k not in got["plus"]) if want is None else math.isclose(got["plus"][k], want, abs_tol=1e-6)
