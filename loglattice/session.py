"""The engine: queries over files, tables and streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import null, NUMBER, Val, display, number
from .plans import planner
from .plans.aliases import ALIASES
from .plans.planner import Options
from .plans.state import State, col
from .sources import tables, text

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true"}


class Result:
    """What a query came to: ``state`` has the typed fields, :meth:`df` plain columns."""

    def __init__(self, state: State, types: dict[str, str] | None = None):
        self.state, self.types = state, types or {}

    @property
    def is_table(self) -> bool:
        return self.state.table

    @property
    def columns(self) -> list[str]:
        return list(self.state.fields)

    def column(self, name: str):
        """A field as a plain column: of the type asked for, else of its own; a dynamic one is text. None is null."""
        v = Val(self.state.fields[name], col(name))
        want = self.types.get(name)
        if v.kind == "dyn":
            shown = F.when(v.col.r != 0, display(v))
            if want is None or want == "string":
                out = shown
            elif want in ("double", "bigint", "int", "float"):
                out = number(v).cast(want)
            elif want == "boolean":
                out = F.when(v.col.r == 1, v.col.n == 1)
            elif want == "timestamp":
                out = F.when(v.col.r == 4, F.timestamp_micros(v.col.i))
            else:
                out = F.from_json(F.when(v.col.r >= NUMBER, v.col.s), want)
        elif v.kind == "none":
            out = null().cast("string")
        elif v.kind == "dur":
            out = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (v.col / F.lit(1_000_000)).cast("decimal(18,6)"))
        else:
            out = v.col.cast(want) if want else v.col
        return out.alias(name)

    def ordered(self) -> DataFrame:
        """The rows in their order, before columns are chosen."""
        s = self.state
        return s.df.orderBy(*(o.column() for o in s.order)) if s.order else s.df

    def errors(self) -> DataFrame:
        """(line, operator, error): the rows that an operator dropped because of an error, with what was wrong."""
        spark = self.state.df.sparkSession
        none = spark.createDataFrame([], "line string, operator string, error string")
        return reduce(DataFrame.unionAll, (rows() for rows in self.state.errors), none)

    def df(self, ordered: bool | None = None) -> DataFrame:
        """Fields as columns; the raw line if there are no fields. Tables come in order, and records if asked for."""
        s = self.state
        base = self.ordered() if (s.table or s.raw is None if ordered is None else ordered) else s.df
        if not s.fields:
            return base.select(F.col(s.raw).alias("line")) if s.raw else base.select(F.lit("").alias("line"))
        return base.select(*map(self.column, s.fields))


class Engine:
    """Compiles queries for a session. Aliases and functions can be added."""

    def __init__(self, spark: SparkSession):
        self.spark, self.aliases, self.functions = spark, dict(ALIASES), {}
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)

    def register_alias(self, name: str, template: str) -> None:
        self.aliases[name] = template

    def register_function(self, name: str, function: Callable, kind: str = "float") -> None:
        """``function`` takes and gives Columns; arguments are numbers if they are numbers, else texts."""

        def run(*args: Val) -> Val:
            cols = [number(a) if a.kind in ("int", "float") else number(a) if kind == "float" else display(a) for a in args]
            out = function(*cols)
            return Val(kind, out, out.isNotNull())

        self.functions[name] = run

    def options(self, **how) -> Options:
        return Options(functions=self.functions, aliases=self.aliases, **how)

    def query(self, query: str, df: DataFrame, *, raw: str | None = None, order_by=None, types: dict[str, str] | None = None, **how) -> Result:
        """A query over a table (see :func:`loglattice.sources.tables.state`). ``types`` are those of dynamic results."""
        state, _ = planner.plan(query, tables.state(df, self.options(**how), raw, order_by))
        return Result(state, types)

    def query_text(self, query: str, path: str | list[str], *, types: dict[str, str] | None = None, **how) -> Result:
        """A query over the lines of text files."""
        state, _ = planner.plan(query, text.state(text.lines(self.spark, path), self.options(**how)))
        return Result(state, types)

    def query_lines(self, query: str, lines: list[str], **how) -> Result:
        """A query over lines at hand."""
        rows = self.spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "_ord long, _raw string")
        state, _ = planner.plan(query, text.state(rows, replace(self.options(**how), order_column="_ord")))
        return Result(state)


__all__ = ["Engine", "Result", "State"]
