"""Results as text: aligned columns, JSON, logfmt or a format string; and as files."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.values import Val, dyn
from ..plans.state import col

MISSING = object()
SPARE, WIDEST = 8, 240


class Value:
    """A dynamic value on the driver."""

    __slots__ = ("rank", "value")

    def __init__(self, rank: int, value):
        self.rank, self.value = rank, value

    @classmethod
    def of(cls, d):
        if d is None:
            return MISSING
        r, n, i, s = d
        return cls(r, {0: lambda: None, 1: lambda: n == 1, 2: lambda: n if i is None else i, 3: lambda: s, 4: lambda: i, 5: lambda: i}.get(r, lambda: json.loads(s))())

    def shown(self) -> str:
        if self.rank == 4:
            return datetime.fromtimestamp(self.value // 1_000_000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") + fraction(self.value) + " UTC"
        return span(self.value) if self.rank == 5 else shown(self.value)

    def jsonable(self):
        if self.rank == 4:
            return datetime.fromtimestamp(self.value // 1_000_000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") + fraction(self.value) + "Z"
        if self.rank == 5:
            return f"PT{self.value / 1e6:g}S"
        if isinstance(self.value, float) and not math.isfinite(self.value):
            return None
        return self.value


def fraction(micros: int) -> str:
    rest = micros % 1_000_000
    return "" if not rest else f".{rest // 1000:03d}" if rest % 1000 == 0 else f".{rest:06d}"


def span(micros: int) -> str:
    """A duration by its parts: 2w2d5h."""
    out, left = "-" if micros < 0 else "", abs(micros)
    for unit, size in (("w", 604800_000_000), ("d", 86400_000_000), ("h", 3600_000_000), ("m", 60_000_000), ("s", 1_000_000), ("ms", 1000), ("us", 1)):
        n, left = divmod(left, size)
        if n:
            out += f"{n}{unit}"
    return out or "0s"


def shown(v) -> str:
    """A plain value: floats with two decimals, arrays in brackets, objects in braces with their keys in order."""
    if v is None:
        return "None"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else ("inf" if v > 0 else "-inf") if math.isinf(v) else f"{v:.2f}"
    if isinstance(v, list):
        return "[" + ", ".join(map(shown, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{k}:{shown(v[k])}" for k in sorted(v)) + "}"
    return str(v)


def rows(result) -> Iterator[tuple[dict[str, Value], str]]:
    """(fields that are there, raw line) of each row, fetched part by part."""
    s = result.state
    fields = [F.struct(dyn(Val(k, col(x))).alias("v")).alias(f"c{n}") for n, (x, k) in enumerate(s.fields.items())]
    raw = F.col(s.raw) if s.raw else F.lit("")
    for row in result.ordered().select(*fields, raw.alias("raw")).toLocalIterator():
        made = {x: Value.of(row[f"c{n}"]["v"]) for n, x in enumerate(s.fields)}
        yield {k: v for k, v in made.items() if v is not MISSING}, row["raw"] or ""


class Widths(dict):
    """A column gets some room more than its widest value so far, so that it need not grow often."""

    def see(self, name: str, value: Value) -> None:
        size = max(len(value.shown()), len(name))
        if size >= self.get(name, 0):
            self[name] = size + SPARE


def records(found: Iterable[tuple[dict[str, Value], str]], width: int | None = None) -> Iterator[str]:
    """A line for each record: ``[key=value]`` in columns; new keys come in order behind those seen before."""
    widths, order = Widths(), []
    for values, raw in found:
        for k, v in values.items():
            widths.see(k, v)
        order += sorted(k for k in values if k not in order)
        if not order:
            yield raw.rstrip()
            continue
        over = lambda: width is not None and sum(w + len(k) + 3 for k, w in widths.items()) > width
        tight = False
        if over():
            widths, order = Widths(), sorted(values)
            for k, v in values.items():
                widths.see(k, v)
            tight = over()
        cells = [(f"[{k}={values[k].shown()}]" if k in values else "", len(k) + 3 + widths[k]) for k in order]
        yield "".join(c if tight else c.ljust(w) for c, w in cells).strip()


def table(columns: list[str], found: list[dict[str, Value]], width: int = WIDEST) -> str:
    """All rows of an aggregate under a header; columns that don't fit are cut with an ellipsis."""
    if not found:
        return "No data\n"
    none, widths = Value(0, None), Widths()
    for row in found:
        for c in columns:
            widths.see(c, row.get(c, none))
    if sum(widths.values()) > width:
        left = width
        for k, c in enumerate(columns):
            widths[c] = min(widths[c], left // (len(columns) - k))
            left -= widths[c]
    def cell(text: str, w: int) -> str:  # noqa: E306
        return text[: max(0, w - 2)] + "… " if len(text) > w else text.ljust(w)
    head = "".join(c.ljust(widths[c]) for c in columns)
    lines = ["".join(cell(row.get(c, none).shown(), widths[c]) for c in columns).strip() for row in found]
    return "\n".join([head.strip(), "-" * len(head), *lines]) + "\n"


_SPEC = re.compile(r"\{(\w+)(?::([<>^]?)(\d*)(?:\.(\d+))?)?\}")


def formatted(template: str, values: dict[str, Value]) -> str:
    """``{name}``, ``{name:<30}`` or ``{name:<10.3}``; what is missing is None."""

    def put(m: re.Match) -> str:
        v = values.get(m.group(1), Value(0, None))
        text = v.shown()
        if m.group(4):
            text = f"{v.value:.{int(m.group(4))}f}" if isinstance(v.value, float) else text[: int(m.group(4))]
        w = int(m.group(3) or 0)
        return text.rjust(w) if m.group(2) == ">" else text.center(w) if m.group(2) == "^" else text.ljust(w)

    return _SPEC.sub(put, template)


def check_format(template: str) -> None:
    rest = _SPEC.sub("", template)
    if "{" in rest or "}" in rest:
        raise PlanError(f"not a format: {template}")


def record_lines(found: Iterable[tuple[dict[str, Value], str]], mode: str = "legacy", template: str = "", width: int | None = None) -> Iterator[str]:
    """A line for each of the records, as they come."""
    if mode == "format":
        check_format(template)
    if mode == "json":
        for values, _ in found:
            yield json.dumps({k: values[k].jsonable() for k in sorted(values)}, ensure_ascii=False, separators=(",", ":"))
    elif mode == "logfmt":
        for values, _ in found:
            yield " ".join(f"{k}={values[k].shown()}" for k in sorted(values))
    elif mode == "format":
        for values, _ in found:
            yield formatted(template, values)
    elif mode == "legacy":
        yield from records(found, width)
    else:
        raise PlanError(f"there is no output '{mode}'")


def lines(result, mode: str = "legacy", template: str = "", width: int | None = None) -> Iterator[str]:
    """The output of a query, line by line."""
    found = rows(result)
    if result.is_table and mode == "json":
        yield "[" + ",".join(json.dumps({c: r[c].jsonable() if c in r else None for c in result.columns}, ensure_ascii=False, separators=(",", ":")) for r, _ in found) + "]"
    elif result.is_table and mode == "legacy":
        yield table(result.columns, [r for r, _ in found], width or WIDEST).rstrip("\n")
    else:
        yield from record_lines(found, mode, template, width)


def write_json(result, path: str) -> None:
    """Results of any size as JSON files: one object for each row, nulls kept."""
    result.df(ordered=False).write.option("ignoreNullFields", "false").json(path)


def logfmt_column(result):
    """Each row as one text ``k=v ...``, made where the row is."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(result.column(c).cast("string"), F.lit("None"))) for c in sorted(result.columns)]
    return F.concat_ws(" ", *parts)
