"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, columns, fresh, written

BUCKETS = 4096
#: a row for each source is sent to every task up to this number of sources; beyond it the rows are joined by source
BROADCAST_SOURCES = 200_000


def source_targets(docs: DataFrame, *, source_col: str = "source", size_col: str = "n_chars", targets: dict | None = None, other: float = 0, total: int | None = None) -> DataFrame:
    """(source, want, mass, n): how many documents to draw from each source, the sum of its documents' measures, and their number.

    ``targets`` gives a weight for each source (None is the null source), ``other`` that of those not named. Without
    targets a source weighs the square root of its number of documents, so that large ones don't drown the rest.
    ``total`` is the size of the mixture, by default the number of documents. Shares are rounded down; what is left
    goes one by one to the largest remainders. All arithmetic is on integers. The result has one row for each source.
    """
    per = docs.groupBy(column(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(measure(size_col)).alias("mass"))
    if targets is None:
        weight = F.round(F.sqrt(F.col("n").cast("double")) * 1000).cast("long")
    else:
        weight = F.lit(round(other * 1_000_000)).cast("long")
        for name, w in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(round(w * 1_000_000)).cast("long")).otherwise(weight)
    every = Window.partitionBy()
    per = per.withColumn("weight", weight)
    per = per.withColumns({"all": F.sum("weight").over(every), "total": F.sum("n").over(every) if total is None else F.lit(int(total)).cast("long")})
    share = F.col("total").cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)")
    per = per.where("all > 0").withColumn("share", share).withColumns({"whole": F.expr("share div all"), "rest": F.expr("share % all")})
    left = F.col("total") - F.sum("whole").over(every)
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("rest"), F.asc_nulls_first("source")))
    return per.withColumn("extra", F.when(place <= left, 1).otherwise(0)).where("weight > 0").select("source", (F.col("whole") + F.col("extra")).alias("want"), "mass", "n")


def measure(size_col: str):
    """A document's expected copies are in proportion to this: the square root of its size, rounded up; at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.greatest(F.coalesce(column(size_col).cast("double"), F.lit(0.0)), F.lit(0.0)))).cast("long")).cast("long")


def _uniform(*parts) -> Column:
    """A number between 0 and 1 from a hash of texts."""
    return (F.conv(F.substring(F.md5(F.concat(*parts)), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def _last(rows: DataFrame, goal: DataFrame, few: bool) -> DataFrame:
    """(source, v, m, c): of the ``goal.due`` rows of least ``v`` in each source the last one's v, how many to take of those that have it, and how many have it.

    ``rows`` are (source, v) with 0 <= v < 1. Counts by bucket of v find the bucket where the last one lies, and only
    that bucket's values are counted and sorted.
    """
    b = F.floor(F.col("v") * BUCKETS).cast("int")
    up = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("source", b.alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0)))
    here = counts.alias("x").join(goal.alias("g"), F.col("x.source").eqNullSafe(F.col("g.source"))).where("before < due and before + x.n >= due")
    here = here.select(F.col("x.source").alias("source"), F.col("x.b").alias("b"), (F.col("due") - F.col("before")).alias("k")).alias("h")
    near = rows.withColumn("b", b).alias("r").join(F.broadcast(here) if few else here, F.col("r.source").eqNullSafe(F.col("h.source")) & (F.col("r.b") == F.col("h.b")))
    each = near.groupBy(F.col("r.source").alias("source"), F.col("r.v").alias("v"), F.col("h.k").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("source").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("before", before).where("before < k and before + c >= k").select("source", "v", (F.col("k") - F.col("before")).alias("m"), "c")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars", targets: dict | None = None, other: float = 0, total: int | None = None, seed: str = "mix", copy_col: str | None = None) -> DataFrame:
    """``docs`` with each row repeated as often as it was drawn; sources then have exactly their target sizes.

    A document of measure x in a source of mass X that is to give N documents has N·x/X expected copies. The whole
    part is allocated for certain. For the rest p the source's documents are ranked by the odds of a random number
    divided by the odds of p (Rosén's Pareto sampling), and as many as are still due are taken from the front. The
    random number is a hash of the seed and the id.

    No source is ranked in one task: counts by bucket of the ranking variable find the bucket where the last one
    due lies, and only that bucket is sorted (:func:`_last`). The cut then filters all rows where they are; texts
    don't move unless there are more than BROADCAST_SOURCES sources.

    Nulls: a null source is a source of its own, a null or negative size counts as 0. A null id draws by the content
    of its row. Where the cut falls between rows of equal rank (a repeated id), a hash of the whole row ranks them;
    of rows that are equal in all columns, which can't be told apart, one stands for as many as are due. Sizes are
    thus exact for any rows. A source in which nothing is drawn has no rows. ``copy_col`` numbers the copies of a row.
    """
    t, x, r, v, whole, copies, tie = (fresh(docs, f"_{n}") for n in ("t", "x", "r", "v", "whole", "copies", "tie"))
    goal = written(source_targets(docs, source_col=source_col, size_col=size_col, targets=targets, other=other, total=total), "goal")
    few = goal.count() <= BROADCAST_SOURCES
    content = F.to_json(F.struct(*columns(docs.columns)), {"ignoreNullFields": "false"})
    rank = F.coalesce(column(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(content)) if not docs.where(column(id_col).isNull()).isEmpty() else F.lit(""))

    def drawn(rows: DataFrame, goal: DataFrame) -> DataFrame:
        packed = goal.select(F.struct("*").alias(t))
        rows = rows.join(F.broadcast(packed) if few else packed, column(source_col).eqNullSafe(F.col(f"{t}.source")))
        due = F.col(f"{t}.want") * column(x)
        rows = rows.withColumn(x, measure(size_col)).withColumns({whole: F.expr(f"{t}.want * `{x}` div {t}.mass"), r: due % F.col(f"{t}.mass")})
        u = _uniform(F.lit(seed + ":"), rank)
        left = (F.col(f"{t}.mass") - column(r)).cast("double")
        q = (u * left) / ((1 - u) * column(r).cast("double"))
        return rows.withColumn(v, F.when(column(r) > 0, q / (1 + q)))

    sure = drawn(docs, goal).groupBy(F.col(f"{t}.source").alias("source")).agg(F.sum(whole).alias("sure"))
    due = goal.alias("a").join(sure.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", (F.col("want") - F.col("sure")).alias("due"))
    goal = written(due, "goal")
    ranked = drawn(docs, goal).where(column(v).isNotNull()).select(F.col(f"{t}.source").alias("source"), column(v).alias("v"))
    goal = written(_with_cut(goal, _last(ranked, goal, few), "v", "m", "c"), "goal")
    # where the cut falls between rows of the same rank, a hash of the row goes on
    at = column(v) == F.col(f"{t}.v")
    torn = not goal.where("m < c").isEmpty()
    if torn:
        tied = drawn(docs, goal.where("m < c")).where(at).select(F.col(f"{t}.source").alias("source"), _uniform(content).alias("v"))
        goal = written(_with_cut(goal, _last(tied, goal.where("m < c").select("source", F.col("m").alias("due")), few), "v2", "m2", "c2"), "goal")
    else:
        goal = goal.withColumns({"v2": F.lit(None).cast("double"), "m2": F.lit(0).cast("long"), "c2": F.lit(0).cast("long")})
    rows = drawn(docs, goal)
    number = copy_col or fresh(docs, "_copy")
    taken = (column(v) < F.col(f"{t}.v")) | (at & (F.col(f"{t}.m") == F.col(f"{t}.c")))
    if torn:
        rows = rows.withColumn(tie, F.when(at & (F.col(f"{t}.m") < F.col(f"{t}.c")), _uniform(content)))
        taken = taken | (column(tie) < F.col(f"{t}.v2")) | ((column(tie) == F.col(f"{t}.v2")) & (F.col(f"{t}.m2") == F.col(f"{t}.c2")))
    out = rows.withColumn(copies, column(whole) + F.when(taken, 1).otherwise(0)).where(column(copies) > 0)
    out = out.select(*columns(docs.columns), F.explode(F.sequence(F.lit(1), column(copies).cast("int"))).alias(number))
    if torn:
        same = rows.where((column(tie) == F.col(f"{t}.v2")) & (F.col(f"{t}.m2") < F.col(f"{t}.c2")))
        one = same.groupBy(F.col(f"{t}.source")).agg(F.first(F.struct(*columns(docs.columns))).alias(t), F.first(whole).alias(whole), F.first(F.col(f"{t}.m2")).alias(copies))
        more = one.select(F.col(f"{t}.*"), whole, F.explode(F.sequence(F.lit(1), column(copies).cast("int"))).alias(copies))
        out = out.union(more.select(*columns(docs.columns), (column(whole) + 1).cast("int").alias(number)))
    return out if copy_col else out.select(*columns(docs.columns))


def _with_cut(goal: DataFrame, cut: DataFrame, *names: str) -> DataFrame:
    cut = cut.select("source", *(F.col(c).alias(n) for c, n in zip("vmc", names))).alias("c")
    return goal.alias("g").join(cut, F.col("g.source").eqNullSafe(F.col("c.source")), "left").select("g.*", *(F.col(f"c.{n}") for n in names))


#: target weights of the registered query, and what a source not named weighs
TARGETS = {f"src{k}": w for k, w in enumerate((8, 8, 4, 4, 4, 4, 2, 2, 2, 2, 2, 2))}
OTHER = 1

_SQL = """
WITH per AS (
  SELECT source, count(*) AS n, sum(greatest(1, CAST(ceil(sqrt(greatest(coalesce(n_chars, 0), 0))) AS BIGINT)))::BIGINT AS mass,
         @WEIGHT@ AS weight
  FROM documents GROUP BY source),
shares AS (
  SELECT *, (sum(n) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS allw FROM per),
parts AS (SELECT *, (total::HUGEINT * weight // allw)::BIGINT AS whole, (total::HUGEINT * weight % allw)::BIGINT AS rest FROM shares),
goal AS (
  SELECT source, mass, (whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, source ASC NULLS FIRST)
         <= total - sum(whole) OVER () THEN 1 ELSE 0 END)::BIGINT AS want FROM parts),
rows0 AS (
  SELECT d.doc_id, d.source, g.want, g.mass,
         greatest(1, CAST(ceil(sqrt(greatest(coalesce(d.n_chars, 0), 0))) AS BIGINT)) AS x,
         (('0x' || substr(md5('mix:' || d.doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
rows1 AS (SELECT *, want * x // mass AS whole, want * x % mass AS r FROM rows0),
odds AS (SELECT *, CASE WHEN r > 0 THEN (u * (mass - r)::DOUBLE) / ((1 - u) * r::DOUBLE) END AS odds FROM rows1),
rows2 AS (SELECT *, odds / (1 + odds) AS q, want - sum(whole) OVER (PARTITION BY source) AS due FROM odds),
rows3 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id) AS place FROM rows2),
copies AS (SELECT doc_id, source, whole + CASE WHEN place <= due AND r > 0 THEN 1 ELSE 0 END AS n FROM rows3)
SELECT doc_id, source, unnest(range(1, n::BIGINT + 1))::INT AS copy FROM copies WHERE n > 0
"""

_NAMED = " ".join(f"WHEN '{k}' THEN {w * 1_000_000}" for k, w in TARGETS.items())
#: for the square roots of the sources' sizes, and for TARGETS
ROOTS_SQL = _SQL.replace("@WEIGHT@", "CAST(round(sqrt(count(*)::DOUBLE) * 1000) AS BIGINT)")
MIX_SQL = _SQL.replace("@WEIGHT@", f"CASE source {_NAMED} ELSE {OTHER * 1_000_000} END")
