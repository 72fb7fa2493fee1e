"""Queries that go on: over a stream, with results renewed as rows arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..errors import PlanError
from ..plans import nodes as n
from ..plans import planner
from ..plans.grammar import Parser
from ..session import Engine, Result
from ..sources import tables, text


def start(engine: Engine, query: str, rows: DataFrame, show: Callable[[Result], None], *, raw: str | None = None, watermark: tuple[str, str] | None = None, trigger: dict | None = None, checkpoint: str | None = None, **how) -> StreamingQuery:
    """Run ``query`` over the streaming ``rows`` and call ``show`` with each new result.

    Up to the first aggregate all is one streaming query in complete mode, its state kept by Spark; the operators
    behind it are a batch query over each new snapshot of the aggregate. Without an aggregate each micro-batch is
    shown as it comes; a limit then ends once its rows have been shown. ``watermark`` is a column and a delay.
    """
    options = engine.options(**how)
    if watermark:
        rows = rows.withWatermark(*watermark)
    ops = planner.spliced(Parser(query, options.aliases).query().operators, options.aliases)
    state = text.state(rows, options) if rows.columns == ["_raw"] else tables.state(rows, options, raw)
    head = any(isinstance(op, n.Aggregate) for op in ops)
    before = ops[: next(k for k, op in enumerate(ops) if isinstance(op, n.Aggregate))] if head else ops
    held = [op for op in before if isinstance(op, (n.Total, n.Sort, n.Limit))]
    if any(isinstance(op, (n.Total, n.Sort)) or op.count < 0 for op in held) or head and held or len(held) > 1 or held and before[-1] is not held[0]:
        raise PlanError("on a stream, sort, total and limit stand behind an aggregate; a limit may end a query of records")
    left = [int(held[0].count)] if held else [None]
    if held:
        query_ops = before[:-1]
        first = planner.start(Parser(query, options.aliases).query(), state.with_(text=query))
        for k, op in enumerate(query_ops):
            first = planner.apply(first, op, query_ops, k)
        rest = []
    else:
        first, rest = planner.plan(query, state, until_aggregate=True)

    def batch(df: DataFrame, _: int) -> None:
        snapshot = first.with_(df=df)
        if left[0] is not None:
            if left[0] <= 0:
                return
            df = df.limit(left[0]).persist()
            left[0] -= df.count()
            snapshot = first.with_(df=df)
        show(Result(planner.resume(snapshot, rest)))

    writer = first.df.writeStream.foreachBatch(batch).outputMode("complete" if head else "append").trigger(**(trigger or {"processingTime": "50 milliseconds"}))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
