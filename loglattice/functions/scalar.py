"""The scalar functions. Each takes values and gives one; what it can't take is an error in that row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import ARRAY, DATE, NONE, null, NUMBER, OBJECT, STRING, Val, boolean, both, display, dyn, number, struct, typed

Function = Callable[..., Val]
REGISTRY: dict[str, Function] = {}


class Arity(Exception):
    """A function with the wrong number of arguments: every row is an error."""


def of(name: str, *counts: int):
    def put(f: Function) -> Function:
        def checked(*args: Val) -> Val:
            if counts and len(args) not in counts:
                raise Arity(f"The '{name}' function expects {counts[0]} arguments, found {len(args)}")
            return f(*args)

        REGISTRY[name] = checked
        return f

    return put


def _double(x: Column, ok: Column | None = None) -> Val:
    return Val("float", x, x.isNotNull() if ok is None else ok)


def _below(f, edge: float):
    """A logarithm: -inf at ``edge``, NaN below."""
    return lambda x: F.when(x < edge, float("nan")).when(x == edge, float("-inf")).otherwise(f(F.greatest(x, F.lit(edge))))


_ONE = {
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "cbrt": F.cbrt, "ceil": lambda x: F.when(F.abs(x) < 9e18, F.ceil(F.when(F.abs(x) < 9e18, x)).cast("double")).otherwise(x),
    "cos": F.cos, "cosh": F.cosh, "exp": F.exp, "expm1": F.expm1, "floor": lambda x: F.when(F.abs(x) < 9e18, F.floor(F.when(F.abs(x) < 9e18, x)).cast("double")).otherwise(x), "log": _below(F.ln, 0.0), "log10": _below(F.log10, 0.0), "log1p": _below(F.log1p, -1.0),
    "round": lambda x: F.round(x, 0), "sin": F.sin, "sinh": F.sinh, "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh, "toDegrees": F.degrees, "toRadians": F.radians, "num": lambda x: x,
}


def _numeric(f, count: int) -> Function:
    def run(*args: Val) -> Val:
        xs = [number(a) for a in args]
        good = xs[0].isNotNull()
        for x in xs[1:]:
            good = good & x.isNotNull()
        return _double(f(*xs), good)

    return run


for _name, _f in _ONE.items():
    of(_name, 1)(_numeric(_f, 1))
of("atan2", 2)(_numeric(F.atan2, 2))
of("hypot", 2)(_numeric(F.hypot, 2))


def _text(x: Column) -> Val:
    return Val("str", x, x.isNotNull())


@of("concat")
def concat(*args: Val) -> Val:
    return _text(F.concat(*map(display, args)) if args else F.lit(""))


@of("contains", 2)
def contains(where: Val, what: Val) -> Val:
    x = display(where).contains(display(what))
    return Val("bool", x, x.isNotNull())


@of("length", 1)
def length(v: Val) -> Val:
    chars = F.char_length(display(v)).cast("bigint")
    if v.kind == "dyn":
        d = v.col
        parsed = F.try_parse_json(F.when(d.r >= ARRAY, d.s))
        size = F.when(d.r == ARRAY, F.size(F.try_variant_get(parsed, "$", "array<variant>"))).when(d.r == OBJECT, F.size(F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>"))))
        chars = F.coalesce(size.cast("bigint"), chars)
    return Val("int", chars, chars.isNotNull())


@of("substring", 2, 3)
def substring(s: Val, start: Val, end: Val | None = None) -> Val:
    text, a = display(s), number(start, dates=False)
    a = F.when(a >= 0, F.floor(a).cast("int"))
    if end is None:
        out = F.when(a.isNotNull(), F.substring(text, a + 1, F.lit(2**31 - 1)))
    else:
        b = number(end, dates=False)
        b = F.when(b >= 0, F.floor(b).cast("int"))
        out = F.when(a <= b, F.substring(text, a + 1, b - a))
    return _text(out)


def _cased(f) -> Function:
    def run(v: Val) -> Val:
        return Val("dyn", typed(f(display(v))))

    return run


of("toLowerCase", 1)(_cased(F.lower))
of("toUpperCase", 1)(_cased(F.upper))


@of("isNull", 1)
def is_null(v: Val) -> Val:
    if v.kind == "dyn":
        return Val("bool", v.col.r == NONE, v.col.isNotNull())
    return Val("bool", F.lit(True) if v.kind == "none" else v.col.isNull(), v.ok)


def _blank(test) -> Function:
    def run(v: Val) -> Val:
        if v.kind == "dyn":
            return Val("bool", (v.col.r == NONE) | ((v.col.r == STRING) & test(F.coalesce(v.col.s, F.lit("x")))), v.col.isNotNull())
        if v.kind == "str":
            return Val("bool", F.coalesce(test(v.col), F.lit(True)), v.ok)
        return Val("bool", F.lit(True) if v.kind == "none" else v.col.isNull(), v.ok)

    return run


of("isEmpty", 1)(_blank(lambda s: s == ""))
of("isBlank", 1)(_blank(lambda s: s.rlike(r"\A(?U:\s)*\z")))


@of("isNumeric", 1)
def is_numeric(v: Val) -> Val:
    return Val("bool", number(v).isNotNull(), v.good() if v.kind == "dyn" else v.ok)


@of("parseHex", 1)
def parse_hex(v: Val) -> Val:
    t = F.regexp_replace(F.btrim(display(v), F.lit(" \t\n\r")), r"\A0[xX]", "")
    bare = F.regexp_replace(t, r"\A[+-]?0*(?=.)", "")
    value = F.when(t.rlike(r"\A[+-]?[0-9a-fA-F]+\z") & (F.length(bare) <= 16) & ~((F.length(bare) == 16) & bare.rlike("\\A[89a-fA-F]")), F.conv(bare, 16, 10).try_cast("bigint"))
    value = F.when(t.startswith("-"), -value).otherwise(value)
    return Val("int", value, value.isNotNull())


#: what parseDate tries, in this order, after ISO 8601
FORMATS = (
    "d/MMM/yyyy:HH:mm:ss", "d/MMM/yyyy HH:mm:ss", "d/MMM/yyyy", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "MMM d HH:mm:ss yyyy", "MMM d yyyy HH:mm:ss", "MMM d, yyyy HH:mm:ss", "MMM d, yyyy", "MMM d yyyy", "MMMM d, yyyy", "d MMMM yyyy",
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "yyyyMMdd'T'HHmmss", "yyyyMMdd",
)


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def _by_parts(s: Column) -> Column:
    """A date of which the month is written as a word, whatever the order of its parts and the words between them."""
    group = lambda x, pattern, k=1: F.nullif(F.regexp_extract(x, pattern, k), F.lit(""))
    clock = r"(?i)(\d{1,2})(?::(\d{2}))?(?::(\d{2}))?\s*([ap])\.?m\b|(\d{1,2}):(\d{2})(?::(\d{2}))?"
    month = F.lower(group(s, rf"(?i)\b({_MONTHS.replace(' ', '|')})[a-z]*", 1))
    bare = F.regexp_replace(F.regexp_replace(s, clock, " "), r"[+-]\d{2}:?\d{2}\b", " ")
    year, day = group(bare, r"(?<!\d)(\d{4})(?!\d)"), group(bare, r"(?<!\d)(\d{1,2})(?:st|nd|rd|th)?(?!\d)")
    half, hour = F.lower(group(s, clock, 4)), F.coalesce(group(s, clock, 1), group(s, clock, 5), F.lit("0")).try_cast("int")
    hour = F.when(half.isNull(), hour).when(hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(half == "p", 12).otherwise(0))
    minute, second = (F.coalesce(group(s, clock, a), group(s, clock, b), F.lit("0")).try_cast("int") for a, b in ((2, 6), (3, 7)))
    number = (F.instr(F.lit(_MONTHS), month) + F.lit(3)).cast("int")
    return F.try_make_timestamp_ntz(year.try_cast("int"), F.floor(number / 4).cast("int"), day.try_cast("int"), hour, minute, second.cast("decimal(16,6)"))


@of("parseDate", 1)
def parse_date(v: Val) -> Val:
    """The offset in the text, if any, isn't applied: the time is read as UTC."""
    if v.kind == "date":
        return v
    s = F.regexp_replace(F.btrim(display(v), F.lit(" \t\n\r")), r"\A(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    # the offset goes, behind a time or before the year
    bare = F.regexp_replace(s, r"(?<=\d\d:\d\d)(:\d\d(?:[.,]\d+)?)?\s*(?:Z|[A-Z]{3,4}|[+-]\d\d:?\d\d)(?=\z|\s+\d{4}\z)", "$1")
    full = F.when(bare.rlike(r"\A\d{4}-\d{1,2}(-\d{1,2}([ T].*)?)?\z"), F.regexp_replace(bare, ",(?=\\d+\\z)", ".").try_cast("timestamp_ntz"))
    tries = [full]
    for f in FORMATS:
        tries.append(F.try_to_timestamp(bare, F.lit(f)).cast("timestamp_ntz"))
    tries.append(_by_parts(F.btrim(display(v), F.lit(" \t\n\r"))))
    t = F.coalesce(*tries).cast("timestamp")
    return Val("date", t, t.isNotNull())


@of("now", 0)
def now() -> Val:
    return Val("date", F.current_timestamp())


__all__ = ["REGISTRY", "Arity", "of", "Val", "boolean", "both", "dyn", "number", "struct", "null", "DATE", "NUMBER"]
