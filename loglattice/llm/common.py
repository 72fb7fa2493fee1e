"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it again.

    The table survives the loss of executors, and later plans start from its files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that no result reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str):
    """The column of exactly this name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def columns(names) -> list:
    return [column(c) for c in names]


#: what Python's ``str.split`` takes for blank, as a class of a Java regular expression
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class WordHashes(dict):
    """Word to 64-bit hash, remembered for the words seen so far and emptied when it grows too large."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(a: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return a ^ (a >> np.uint64(31))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole, if there are fewer than ``k`` words."""
    k = max(1, min(k, len(words)))
    n = len(words) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mixed(out * np.uint64(31) + words[j : j + n] + _MIX)
    return out


def blocks(rows: DataFrame, keys: list[str], weight, most: int, by: str) -> DataFrame:
    """``rows`` with (lo, hi, side): groups of ``keys`` whose weights add up to more than ``most`` are cut into blocks by a hash of ``by``.

    A row comes once for each two blocks, lo and hi, of which its own is one: side is 0 where that is lo, 1 where it is
    hi, -1 where both are the same. Every two rows of a group thus meet in one (lo, hi) at least.
    """
    size = rows.groupBy(*keys).agg(F.ceil(F.sum(weight) / most).cast("long").alias("_m")).where("_m > 1")
    cut = rows.join(size, keys, "left").withColumn("_m", F.coalesce("_m", F.lit(1)))
    cut = cut.withColumn("_b", F.pmod(F.xxhash64(by), F.col("_m"))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    side = F.when(F.col("_b") == F.col("_j"), -1).when(F.col("_b") < F.col("_j"), 0).otherwise(1)
    return cut.select(*rows.columns, F.least("_b", "_j").alias("lo"), F.greatest("_b", "_j").alias("hi"), side.alias("side"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of the undirected ``edges`` with the smallest node it is connected to.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until nothing changes; each round is written
    to the shared folder. A round is two aggregations keyed by node; nothing is collected but two sums.
    """
    e = written(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        # large star: every larger neighbour of a node points to the smallest node in its neighbourhood
        both = e.union(e.select("u", "v"))
        m = both.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("least"))
        m = m.select("x", F.least("x", "least").alias("m"))
        large = both.join(m, both["v"] == m["x"]).where("u > v").select(F.col("m").alias("v"), "u").where("u <> v").distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        m = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(m, large["u"] == m["x"])
        small = small.select(F.col("m").alias("v"), F.col("v").alias("u")).union(m.select(F.col("m").alias("v"), F.col("x").alias("u")))
        new = written(small.where("u <> v").distinct(), "edges")
        drop_written(e)
        e = new
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = now
