"""What a pipeline has come to after some of its operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import DYN, Val, display, dyn

_KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "string": "str", "boolean": "bool", "timestamp": "date", "timestamp_ntz": "date", "date": "date"}


@dataclass(frozen=True)
class By:
    """A column to sort by."""

    col: Column
    desc: bool = False
    nulls_last: bool = True

    def column(self, reverse: bool = False) -> Column:
        desc, last = self.desc != reverse, self.nulls_last != reverse
        if desc:
            return self.col.desc_nulls_last() if last else self.col.desc_nulls_first()
        return self.col.asc_nulls_last() if last else self.col.asc_nulls_first()


@dataclass(frozen=True)
class State:
    """``fields`` maps each name to its kind; its column in ``df`` is :func:`col`. A missing value is a null of kind dyn.

    ``order`` has the columns that give the order of the rows; ``natural``: whether it is that of the partitions.
    ``table``: whether rows are those of an aggregate. ``variants`` has for fields of parsed JSON the column of the
    whole and their key in it; ``narrow`` for fields widened from a table's integers the column as the scan knows it. ``errors`` are rows dropped because of an error, each a function that gives a DataFrame (line, operator, error).
    """

    df: DataFrame
    fields: dict[str, str]
    raw: str | None
    order: tuple[By, ...] = ()
    table: bool = False
    options: object = None
    text: str = ""
    errors: tuple = field(default=())
    natural: bool = False
    variants: dict = field(default_factory=dict)
    narrow: dict = field(default_factory=dict)

    def scope(self) -> dict[str, Val]:
        return {name: Val(kind, col(name)) for name, kind in self.fields.items()}

    def with_(self, **changes) -> State:
        return replace(self, **changes)

    def put(self, name: str, v: Val, keep_old: bool = False) -> State:
        """A field set where the value is good; elsewhere it is missing, or as it was."""
        if v.kind != "dyn" and (v.ok is not None or v.kind == "none" or keep_old):
            v = Val("dyn", dyn(v))
        column = v.col
        if keep_old and name in self.fields:
            column = F.coalesce(column, dyn(Val(self.fields[name], col(name))))
        variants = {k: x for k, x in self.variants.items() if k != name}
        return self.with_(df=self.df.withColumn(slot(name), column), fields=self.fields | {name: v.kind}, variants=variants, narrow={k: x for k, x in self.narrow.items() if k != name})

    def failed(self, operator: str, why: Callable[[], Column]) -> State:
        """Note the rows that an operator drops, those in which ``why()`` isn't null. It is called only if errors are asked
        for. Rows of an aggregate go without a word.
        """
        if self.table or self.df.isStreaming:
            return self

        def rows() -> DataFrame:
            line = F.col(self.raw) if self.raw else F.lit("")
            return self.df.select(line.alias("line"), F.lit(operator).alias("operator"), why().alias("error")).where("error is not null")

        return self.with_(errors=(*self.errors, rows))

    def set_all(self, values: dict[str, Val], keep: Column | None = None) -> State:
        """Filter by ``keep``, then set fields that are good in all rows kept."""
        df = self.df if keep is None else self.df.where(keep)
        return self.with_(df=df.withColumns({slot(k): v.col for k, v in values.items()}), fields=self.fields | {k: v.kind for k, v in values.items()}, narrow={k: x for k, x in self.narrow.items() if k not in values})

    def raw_text(self) -> Val:
        return Val("str", F.lit("") if self.raw is None else F.col(self.raw), None if self.raw is None else F.col(self.raw).isNotNull())


def slot(name: str) -> str:
    """The column of a field. Spark's names don't tell upper from lower case; ours do."""
    return "f_" + "".join("^" + c.lower() if c.isupper() else c for c in name)


def col(name: str) -> Column:
    return F.col("`" + slot(name).replace("`", "``") + "`")


def native(df: DataFrame) -> dict[str, str]:
    """Kinds of the columns of a table; arrays, structs, maps and the rest are dynamic."""
    out = {}
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        out[f.name] = _KINDS.get(t, "float" if t.startswith("decimal") else "dyn")
    return out


def lifted(df: DataFrame, name: str, kind: str) -> Column:
    """A table's column as a field of its kind."""
    from ..functions.values import ARRAY, OBJECT, none, struct

    c = F.col(f"`{name.replace('`', '``')}`")
    t = df.schema[name].dataType.simpleString()
    if kind == "int":
        return c.cast("bigint")
    if kind == "float":
        return c.cast("double")
    if kind == "date":
        return c.cast("timestamp")
    if kind == "dyn":
        if t.startswith(("struct", "map", "array")):
            return F.when(c.isNull(), none()).otherwise(struct(ARRAY if t.startswith("array") else OBJECT, s=F.to_json(c, {"ignoreNullFields": "false"})))
        if t == "variant":
            from ..functions.values import from_variant

            return F.coalesce(from_variant(c), none())
        return F.when(c.isNull(), none()).otherwise(struct(3, s=c.cast("string")))
    return c


__all__ = ["State", "slot", "col", "native", "lifted", "DYN", "display"]
