"""Values as Columns.

A value is of a type known when the query is planned, or dynamic (:data:`DYN`): a struct whose order and equality are
those of values of any type. Its fields are the rank of the type, the number, the exact integer (also microseconds of
dates and durations) and the text (strings; JSON of arrays and objects). A null struct is a missing value or an error,
rank 0 is an explicit None.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DYN = "struct<r:tinyint,n:double,i:bigint,s:string>"
NONE, BOOL, NUMBER, STRING, DATE, DURATION, ARRAY, OBJECT = range(8)
BLANKS = " \t\n\r\x0b\x0c"
EPSILON = 2.220446049250313e-16


def null() -> Column:
    return F.lit(None)


@dataclass(frozen=True)
class Val:
    """A Column and its kind: int, float, str, bool, date, dur (microseconds) or dyn.

    ``ok`` is false where the value is missing or an error; None means everywhere fine. A null of a known kind is an
    explicit None. Of dyn, null is an error in itself.
    """

    kind: str
    col: Column
    ok: Column | None = None

    def good(self) -> Column:
        if self.kind == "dyn":
            return self.col.isNotNull()
        return F.lit(True) if self.ok is None else F.coalesce(self.ok, F.lit(False))

    def guarded(self) -> Column:
        """The column, null where it isn't good."""
        return self.col if self.kind == "dyn" or self.ok is None else F.when(self.ok, self.col)


def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it; plans then grow with the depth of expressions
    and not with a power of it, also where filters are pushed down through them.
    """
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def both(*oks: Column | None) -> Column | None:
    out = None
    for ok in oks:
        if ok is not None:
            out = ok if out is None else out & ok
    return out


def struct(r: int, n=None, i=None, s=None) -> Column:
    put = lambda x, t: (null() if x is None else x).cast(t)
    return F.struct(F.lit(r).cast("tinyint").alias("r"), put(n, "double").alias("n"), put(i, "bigint").alias("i"), put(s, "string").alias("s"))


def none() -> Column:
    return struct(NONE)


def from_float(x: Column) -> Column:
    """A float as a dynamic value: an integer if it has no fraction. Null stays null."""
    return let(x, _from_float)


def _from_float(x: Column) -> Column:
    i = x.try_cast("bigint")
    return F.when(x.isNotNull(), struct(NUMBER, x, F.when(F.abs(x - i) < EPSILON, i)))


def dyn(v: Val) -> Column:
    if v.kind == "dyn":
        return v.col
    c = v.col
    made = {
        "int": lambda: struct(NUMBER, c, c),
        "float": lambda: from_float(c),
        "str": lambda: struct(STRING, s=c),
        "bool": lambda: struct(BOOL, n=c.cast("int")),
        "date": lambda: struct(DATE, i=F.unix_micros(c)),
        "dur": lambda: struct(DURATION, i=c),
        "none": none,
    }[v.kind]()
    if v.kind != "none":
        made = F.when(c.isNull(), none()).otherwise(made)
    return made if v.ok is None else F.when(v.ok, made)


def trimmed(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def typed(s: Column) -> Column:
    """Text as a dynamic value: integer, float, true or false, or the trimmed text. Null stays null."""
    return let(trimmed(s), _typed)


def _typed(t: Column) -> Column:
    i = F.when(t.rlike(r"\A[+-]?\d{1,19}\z"), t.try_cast("bigint"))
    number_like = r"\A[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))\z"
    return F.when(t.isNull(), null().cast(DYN)).when(i.isNotNull(), struct(NUMBER, i, i)).when(t.rlike(number_like), from_float(t.try_cast("double"))).when(t.isin("true", "false"), struct(BOOL, n=(t == "true").cast("int"))).otherwise(struct(STRING, s=t))


def scraped(s: Column) -> Column:
    """The number left when all but digits and dots go; null if there is none."""
    t = F.regexp_replace(s, r"[^\p{N}.]", "")
    return F.when(t.rlike(r"\A(\d+\.?\d*|\.\d+)\z"), t.try_cast("double"))


def number(v: Val, dates: bool = True) -> Column:
    """A value as a double; null where it is none. ``dates``: dates count as milliseconds."""
    if v.kind == "dyn":
        return let(v.col, lambda d: _number(d, dates))
    if v.kind in ("int", "float"):
        return v.guarded().cast("double")
    if v.kind == "str":
        return scraped(v.guarded())
    if v.kind == "date" and dates:
        return F.floor(F.unix_micros(v.guarded()) / 1000).cast("double")
    return null().cast("double")


def _number(d: Column, dates: bool) -> Column:
    out = F.when(d.r == NUMBER, d.n).when(d.r == STRING, scraped(d.s))
    return out.when(d.r == DATE, F.floor(d.i / 1000).cast("double")) if dates else out


def boolean(v: Val) -> Column:
    """True or false; null where the value is something else."""
    if v.kind == "bool":
        return v.guarded()
    if v.kind == "dyn":
        return let(v.col, lambda d: F.when(d.r == BOOL, d.n == 1))
    return null().cast("boolean")


def integral(x: Column) -> Column:
    return F.when(x == F.floor(x), F.abs(x) < 1e15).otherwise(False)


def plain(n: Column, i: Column) -> Column:
    """A number in full."""
    return F.when(i.isNotNull(), i.cast("string")).when(integral(n), n.cast("decimal(38,0)").cast("string")).otherwise(n.cast("string"))


def iso(micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def display(v: Val) -> Column:
    """A value as string functions see it; null only for errors."""
    if v.kind == "str":
        shown = F.coalesce(v.col, F.lit("None"))
    elif v.kind == "dyn":
        return let(v.col, _display)
    elif v.kind == "none":
        shown = F.lit("None")
    elif v.kind == "float":
        shown = F.coalesce(plain(v.col, null().cast("bigint")), F.lit("None"))
    elif v.kind in ("date", "dur"):
        return display(Val("dyn", dyn(v)))
    else:
        shown = F.coalesce(v.col.cast("string"), F.lit("None"))
    return shown if v.ok is None else F.when(v.ok, shown)


def from_variant(x: Column) -> Column:
    """A variant as a dynamic value. Null stays null."""
    return let(x, lambda v: let(F.schema_of_variant(v), lambda schema: _from_variant(v, schema)))


def _from_variant(x: Column, schema: Column) -> Column:
    return (
        F.when(x.isNull(), null().cast(DYN))
        .when(schema == "VOID", none())
        .when(schema == "BOOLEAN", struct(BOOL, n=F.try_variant_get(x, "$", "boolean").cast("int")))
        .when(schema == "BIGINT", struct(NUMBER, F.try_variant_get(x, "$", "bigint"), F.try_variant_get(x, "$", "bigint")))
        .when(schema == "STRING", struct(STRING, s=F.try_variant_get(x, "$", "string")))
        .when(schema.startswith("ARRAY"), struct(ARRAY, s=F.to_json(x)))
        .when(schema.startswith("OBJECT"), struct(OBJECT, s=F.to_json(x)))
        .otherwise(from_float(F.try_variant_get(x, "$", "double")))
    )


def _display(d: Column) -> Column:
    seconds = F.concat(F.lit("PT"), plain(d.i / 1e6, null().cast("bigint")), F.lit("S"))
    return F.when(d.r == NONE, F.lit("None")).when(d.r == BOOL, (d.n == 1).cast("string")).when(d.r == NUMBER, plain(d.n, d.i)).when(d.r == DATE, iso(d.i)).when(d.r == DURATION, seconds).when(d.r.isNotNull(), d.s)
