"""Expressions as values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError, nearest
from ..plans import nodes as n
from .scalar import REGISTRY, Arity
from .values import ARRAY, BOOL, DATE, DURATION, DYN, null, NUMBER, STRING, Val, _number, boolean, both, display, dyn, from_float, from_variant, let, number, struct


def error() -> Val:
    return Val("dyn", null().cast(DYN))


class Compiler:
    """Compiles expressions over the fields of a plan state. ``state`` has the columns made by :meth:`bind`."""

    def __init__(self, state):
        self.state, self.scope, self.text, self.functions = state, state.scope(), state.text, state.options.functions

    def bind(self, c: Column) -> Column:
        """A column of its own for what is used more than once."""
        name = f"_t{len(self.state.df.columns)}"
        while name in self.state.df.columns:
            name += "_"
        self.state = self.state.with_(df=self.state.df.withColumn(name, c))
        return F.col(name)

    def __call__(self, node: n.Node) -> Val:
        return getattr(self, "on_" + type(node).__name__.lower())(node)

    def on_literal(self, node: n.Literal) -> Val:
        if node.kind == "null":
            return Val("none", null())
        if node.kind == "dur":
            if node.value % 1000:
                raise PlanError("durations are whole microseconds", self.text, node.at)
            return Val("dur", F.lit(node.value // 1000).cast("bigint"))
        kind = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}[node.kind]
        return Val(node.kind, F.lit(node.value).cast(kind))

    def on_ref(self, node: n.Ref) -> Val:
        if node.name not in self.scope:
            return error()
        v = self.scope[node.name]
        if not node.path:
            return v
        steps = list(node.path)
        root = self.state.variants.get(node.name)
        if root:  # parsed already
            x, steps = F.col(root[0]), [root[1], *steps]
        else:
            x = F.try_parse_json(let(dyn(v), lambda d: F.when(d.r >= ARRAY, d.s)))
        while steps:
            path = "$"
            while steps and not (isinstance(steps[0], int) and steps[0] < 0):
                s = steps.pop(0)
                path += f"[{s}]" if isinstance(s, int) else '["' + s.replace("\\", "\\\\").replace('"', '\\"') + '"]' if '"' in s or "'" in s else f"['{s}']"
            if path != "$":
                x = F.try_variant_get(x, path, "variant")
            if steps:
                items = F.try_variant_get(x, "$", "array<variant>")
                x = F.try_element_at(items, F.lit(steps.pop(0)))
        return Val("dyn", from_variant(x))

    def on_not(self, node: n.Not) -> Val:
        b = boolean(self(node.of))
        return Val("bool", ~b, b.isNotNull())

    def on_if(self, node: n.If) -> Val:
        test, a, b = boolean(self(node.test)), self(node.then), self(node.other)
        if a.kind == b.kind and a.kind != "dyn":
            return Val(a.kind, F.when(test, a.col).otherwise(b.col), F.when(test, a.good()).when(~test, b.good()))
        return Val("dyn", F.when(test, dyn(a)).when(~test, dyn(b)))

    def on_call(self, node: n.Call) -> Val:
        known = REGISTRY | self.functions
        if node.name not in known:
            raise PlanError(f"there is no function '{node.name}'", self.text, node.at, node.at + len(node.name), nearest(node.name, known))
        args = [self(a) for a in node.args]
        if node.name in self.functions:
            return self.functions[node.name](*args)
        try:
            return known[node.name](*args)
        except Arity:
            return error()
        except TypeError:
            return error()

    def on_binary(self, node: n.Binary) -> Val:
        a, b = self(node.left), self(node.right)
        op = node.op
        if op in ("and", "or"):
            return self.logical(op, a, b)
        if op in ("==", "!="):
            return equal(a, b, op == "!=")
        if op in ("<", "<=", ">", ">="):
            return ordered(op, a, b)
        return arithmetic(op, a, b)

    def plain(self, node: n.Node) -> Column | None:
        """A condition that is true in the same rows as ``node``, of bare comparisons that a scan can use to skip data; None
        if there is none. In other rows it may be null where ``node`` is false: it serves as a filter and nowhere else.
        """
        if not isinstance(node, n.Binary):
            return None
        if node.op in ("and", "or"):
            left, right = self.plain(node.left), self.plain(node.right)
            return None if left is None or right is None else left & right if node.op == "and" else left | right
        flipped = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}
        if node.op not in flipped:
            return None
        field, other, op = node.left, node.right, node.op
        if not isinstance(field, n.Ref):
            field, other, op = other, field, flipped[op]
        if not isinstance(field, n.Ref) or field.path or field.name not in self.scope or n.refs(other):
            return None
        x, y = self.scope[field.name], self(other)
        same = x.kind == y.kind and x.kind not in ("dyn", "none") or x.kind in NUMERIC and y.kind in NUMERIC
        if not same or x.ok is not None or isinstance(other, n.Literal) and other.kind == "null":
            return None
        test = {"<": x.col < y.col, "<=": x.col <= y.col, ">": x.col > y.col, ">=": x.col >= y.col, "==": x.col == y.col, "!=": x.col != y.col}[op]
        if op in ("<", "<=", "!="):  # an explicit None is another value, and comes before all else
            test = test | (F.col(self.state.narrow[field.name]) if field.name in self.state.narrow else x.col).isNull()
        return test if y.ok is None else test & y.ok

    def why(self, node: n.Node) -> Column:
        """Why there is no value, as a text; null where there is one."""
        v = self(node)
        reasons: list[Column] = []
        shown = lambda x: F.coalesce(display(self(x)), F.lit("None"))
        if isinstance(node, n.Ref):
            missing = F.lit(f'No value for key "{node.name}"')
            if node.path and node.name in self.scope:
                last = node.path[-1]
                reasons.append(F.when(~self.scope[node.name].good(), missing))
                reasons.append(F.lit(f"Index {last} out of range" if isinstance(last, int) else f'No value for key "{last}"'))
            else:
                reasons.append(missing)
        elif isinstance(node, n.Not):
            reasons += [self.why(node.of), F.concat(F.lit("Expected boolean, found "), shown(node.of))]
        elif isinstance(node, n.If):
            test = boolean(self(node.test))
            reasons += [self.why(node.test), F.when(test.isNull(), F.concat(F.lit("Expected boolean, found "), shown(node.test)))]
            reasons += [F.when(test, self.why(node.then)), F.when(~test, self.why(node.other))]
        elif isinstance(node, n.Binary):
            left, right = self.why(node.left), self.why(node.right)
            if node.op in ("and", "or"):
                reasons += [left, F.when(boolean(self(node.left)).isNull(), F.concat(F.lit("Expected boolean, found "), shown(node.left))), right]
            else:
                reasons += [left, right, F.concat(F.lit("Expected numeric operands, found "), shown(node.left), F.lit(f" {node.op} "), shown(node.right))]
        elif isinstance(node, n.Call):
            reasons += [self.why(a) for a in node.args]
            try:
                {**REGISTRY, **self.functions}[node.name](*(self(a) for a in node.args))
            except (Arity, TypeError) as e:
                reasons.append(F.lit(str(e) if isinstance(e, Arity) else f"The '{node.name}' function can't take {len(node.args)} arguments"))
            found = F.concat_ws(", ", *map(shown, node.args)) if node.args else F.lit("nothing")
            reasons.append(F.concat(F.lit(f"The '{node.name}' function failed with the error: it can't take "), found))
        reasons.append(F.lit(f"{getattr(node, 'text', 'the expression')} has no value"))
        return F.when(~v.good(), F.coalesce(*reasons))

    def logical(self, op: str, a: Val, b: Val) -> Val:
        left = boolean(a)
        if b.kind == "bool":
            right = b.guarded()
            out = F.when(left, right).when(~left, False) if op == "and" else F.when(left, True).when(~left, right)
            return Val("bool", out, out.isNotNull())
        known = struct(BOOL, n=F.lit(1 if op == "or" else 0))
        return Val("dyn", F.when(left, dyn(b) if op == "and" else known).when(~left, known if op == "and" else dyn(b)))


NUMERIC = ("int", "float")


def equal(a: Val, b: Val, negated: bool) -> Val:
    if a.kind == b.kind and a.kind not in ("dyn", "none") or a.kind in NUMERIC and b.kind in NUMERIC:
        out = a.col.eqNullSafe(b.col)
        ok = both(a.ok, b.ok)
    else:
        pair = F.struct(dyn(a).alias("a"), dyn(b).alias("b"))
        out = let(pair, lambda p: F.when(p.a.isNotNull() & p.b.isNotNull(), p.a.eqNullSafe(p.b)))
        ok = out.isNotNull()
    return Val("bool", ~out if negated else out, ok)


def less(x: Column, y: Column) -> Column:
    """Whether one dynamic value comes before another: by type, then numbers, texts, dates; arrays are all equal."""
    return F.when(x.r != y.r, x.r < y.r).when(x.r <= NUMBER, F.coalesce(x.n < y.n, F.lit(False))).when(x.r.isin(DATE, DURATION), x.i < y.i).when(x.r == ARRAY, False).otherwise(x.s < y.s)


def ordered(op: str, a: Val, b: Val) -> Val:
    plain = a.kind == b.kind and a.kind not in ("dyn", "none") or a.kind in NUMERIC and b.kind in NUMERIC
    if plain:
        x, y = a.col, b.col
        out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        # an explicit None comes before all else
        none = {"<": x.isNull() & y.isNotNull(), "<=": x.isNull(), ">": x.isNotNull() & y.isNull(), ">=": y.isNull()}[op]
        return Val("bool", F.coalesce(out, none), both(a.ok, b.ok))
    pair = F.struct(dyn(a).alias("a"), dyn(b).alias("b"))
    test = {"<": less, ">": lambda x, y: less(y, x), "<=": lambda x, y: ~less(y, x), ">=": lambda x, y: ~less(x, y)}[op]
    out = let(pair, lambda p: F.when(p.a.isNotNull() & p.b.isNotNull(), test(p.a, p.b)))
    return Val("bool", out, out.isNotNull())


def quotient(x: Column, y: Column) -> Column:
    at_zero = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
    return F.when(y == 0, at_zero).otherwise(x / F.when(y != 0, y))


_OPS = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": quotient}
_INT = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}


def arithmetic(op: str, a: Val, b: Val) -> Val:
    kinds = (a.kind, b.kind)
    if all(k in NUMERIC for k in kinds):
        ok = both(a.ok, b.ok, a.col.isNotNull() & b.col.isNotNull())
        if op != "/" and kinds == ("int", "int"):
            out = _INT[op](a.col, b.col)
            return Val("int", out, both(ok, out.isNotNull()))
        return Val("float", _OPS[op](a.col.cast("double"), b.col.cast("double")), ok)
    result = _DATED.get((op, *kinds))
    if result:
        x, y = (F.unix_micros(v.col) if v.kind == "date" else v.col for v in (a, b))
        out = _INT[op](x, y) if op != "/" else _toward_zero(x, y)
        return Val(result, F.timestamp_micros(out) if result == "date" else out, both(a.ok, b.ok, out.isNotNull()))
    if "dyn" not in kinds and not {"date", "dur"} & set(kinds):
        x, y = number(a), number(b)
        return Val("float", _OPS[op](x, y), x.isNotNull() & y.isNotNull())
    pair = F.struct(dyn(a).alias("a"), dyn(b).alias("b"))
    return Val("dyn", let(pair, lambda p: let(F.struct(p.a.alias("a"), p.b.alias("b"), _number(p.a, True).alias("x"), _number(p.b, True).alias("y")), lambda q: _dynamic(op, q.a, q.b, q.x, q.y))))


def _dynamic(op: str, a: Column, b: Column, x: Column, y: Column) -> Column:
    """Dynamic values and their numbers."""
    numbers = (a.r == NUMBER) & (b.r == NUMBER)
    if op == "/":
        out = from_float(quotient(x, y))
    else:
        ints = numbers & a.i.isNotNull() & b.i.isNotNull()
        exact = let(_INT[op](F.when(ints, a.i), F.when(ints, b.i)), lambda i: F.when(i.isNotNull(), struct(NUMBER, i, i)))
        floats = let(_OPS[op](x, y), lambda z: F.when(z.isNotNull(), struct(NUMBER, z)))
        out = F.when(ints, exact).when(numbers & a.i.isNull() & b.i.isNull(), floats).otherwise(from_float(_OPS[op](x, y)))
    # dates and durations whose kind is only known by row
    code = {"date": DATE, "dur": DURATION, "int": NUMBER}
    cases = [(p, q, kind) for (o, p, q), kind in _DATED.items() if o == op]
    dated = None
    for p, q, kind in cases:
        i = _INT[op](a.i, b.i) if op != "/" else _toward_zero(a.i, b.i)
        made = let(i, lambda i, kind=kind: F.when(i.isNotNull(), struct(code[kind], i=i)))
        here = (a.r == code[p]) & (b.r == code[q])
        dated = F.when(here, made) if dated is None else dated.when(here, made)
    return out if dated is None else dated.otherwise(out)


def _toward_zero(x: Column, y: Column) -> Column:
    return F.when(y != 0, F.try_divide(x.cast("decimal(38,0)"), y.cast("decimal(38,0)")).cast("bigint"))


_DATED = {
    ("+", "date", "dur"): "date", ("+", "dur", "date"): "date", ("-", "date", "dur"): "date", ("-", "date", "date"): "dur", ("+", "dur", "dur"): "dur", ("-", "dur", "dur"): "dur",
    ("*", "dur", "int"): "dur", ("*", "int", "dur"): "dur", ("/", "dur", "int"): "dur",
}

__all__ = ["Compiler", "STRING", "equal", "less", "ordered", "arithmetic"]
