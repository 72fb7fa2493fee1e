"""Near duplicates among embeddings: a robust-pruned flat graph over shards of clusters, searched for every row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, column, components, drop_written, written


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim): unit vectors, one for each id, the least of several."""
    rows = vectors.select(column(id_col).alias("id"), column(vec_col).cast("array<float>").alias("vec"))
    rows = rows.where("id is not null and vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < float('inf'))")
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("norm", F.expr("sqrt(aggregate(vec, 0D, (s, x) -> s + double(x) * x))")).where("norm > 0")
    return rows.select("id", F.expr("transform(vec, x -> float(x / norm))").alias("vec"), F.size("vec").alias("dim"))


# --- one shard in memory


def cosines(X: np.ndarray, Y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows i of X and j of Y, in double precision."""
    out = np.empty(len(i))
    for k in range(0, len(i), 100_000):
        A, B = X[i[k : k + 100_000]].astype(np.float64), Y[j[k : k + 100_000]].astype(np.float64)
        out[k : k + 100_000] = np.einsum("pd,pd->p", A, B) / (np.linalg.norm(A, axis=1) * np.linalg.norm(B, axis=1))
    return out


def robust_pruned(X: np.ndarray, degree: int, alpha: float) -> list[np.ndarray]:
    """Neighbours of each row. All rows of the shard are candidates of all others, the nearest first; each one taken
    strikes out those that are nearer to it, by a factor of ``alpha``, than to the row in question.
    """
    n = len(X)
    D = np.maximum(2 - 2 * (X @ X.T), 0)
    alive = D.copy()
    np.fill_diagonal(alive, np.inf)
    picked = np.full((n, degree), -1)
    rows = np.arange(n)
    for k in range(min(degree, n - 1)):
        best = alive.argmin(axis=1)
        ok = np.isfinite(alive[rows, best])
        if not ok.any():
            break
        picked[ok, k] = best[ok]
        alive[rows, best] = np.inf
        alive[alpha * alpha * D[best] <= D] = np.inf
    return [p[p >= 0] for p in picked]


def shard_graph(X: np.ndarray, degree: int, alpha: float, most: int) -> list[np.ndarray]:
    """Like :func:`robust_pruned`; more than ``most`` rows are cut in two halves that overlap, their lists united."""
    if len(X) <= most:
        return robust_pruned(X, degree, alpha)
    a = X[0]
    b = X[int((X @ a).argmin())]
    for _ in range(4):
        side = X @ b > X @ a
        if side.all() or not side.any():
            break
        a, b = X[~side].mean(axis=0), X[side].mean(axis=0)
    rank = np.argsort(X @ b - X @ a, kind="stable")
    middle, margin = len(X) // 2, max(1, len(X) // 10)
    lists: list[list[np.ndarray]] = [[] for _ in range(len(X))]
    for part in (rank[: middle + margin], rank[middle - margin :]):
        for k, near in zip(part, shard_graph(X[part], degree, alpha, most)):
            lists[k].append(part[near])
    return [np.unique(np.concatenate(x)) for x in lists]


def range_search(X: np.ndarray, near: list[np.ndarray], floor: float, beam: int, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) with a < b: rows whose inner product is ``floor`` or more, as found by a search for every row.

    A greedy search with a ``beam`` of nodes starts at the medoid and at the row's own neighbours, so that a group whose
    edges stay within it is reached by its members. From what it finds within range, the search expands to all
    neighbours within range, and on from those, without a limit.
    """
    n = len(X)
    # edges are followed both ways: who is in nobody's list is found from its own
    to, of = np.concatenate(near) if n else np.zeros(0, np.int64), np.repeat(np.arange(n), [len(x) for x in near])
    edge = np.unique(np.concatenate([of * n + to, to * n + of]))
    of, to = edge // n, edge % n
    begin = np.searchsorted(of, np.arange(n + 1))
    width = int(np.diff(begin).max()) if len(edge) else 1
    medoid = int((X @ X.mean(axis=0)).argmax())
    left, right = [], []

    def steps(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, neighbour) for each neighbour of v."""
        size = begin[v + 1] - begin[v]
        at = np.repeat(begin[v] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.repeat(q, size), to[at]

    for at in range(0, n, chunk):
        Q = X[at : at + chunk]
        m = len(Q)
        seen = np.zeros((m, n), bool)
        seen[np.arange(m), at + np.arange(m)] = True
        q, v = steps(np.arange(m), at + np.arange(m))
        q, v = np.concatenate([q, np.arange(m)]), np.concatenate([v, np.full(m, medoid)])
        nodes, score, opened = np.zeros((m, 0), np.int64), np.zeros((m, 0), np.float32), np.zeros((m, 0), bool)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):
            pair = np.unique(q * n + v)
            q, v = pair // n, pair % n
            ok = ~seen[q, v]
            q, v = q[ok], v[ok]
            seen[q, v] = True
            s = np.concatenate([np.einsum("pd,pd->p", Q[q[k : k + 100_000]], X[v[k : k + 100_000]]) for k in range(0, len(q), 100_000)]) if len(q) else np.zeros(0, np.float32)
            hits.append((q[s >= floor], v[s >= floor]))
            # the best of each query's old and new nodes stay in its beam
            order = np.lexsort((-s, q))
            q, v, s = q[order], v[order], s[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            top = place < beam
            w = int(place[top].max()) + 1 if top.any() else 0
            new, ns = np.zeros((m, w), np.int64), np.full((m, w), -3, np.float32)
            new[q[top], place[top]], ns[q[top], place[top]] = v[top], s[top]
            nodes, score, opened = np.concatenate([nodes, new], axis=1), np.concatenate([score, ns], axis=1), np.concatenate([opened, ns < -2], axis=1)
            keep = np.argsort(-score, axis=1, kind="stable")[:, :beam]
            nodes, score, opened = (np.take_along_axis(x, keep, axis=1) for x in (nodes, score, opened))
            best = np.where(opened, -4, score).argmax(axis=1)
            live = np.flatnonzero(~opened[np.arange(m), best])
            opened[live, best[live]] = True
            q, v = steps(live, nodes[live, best[live]])
        q, v = (np.concatenate(x) for x in zip(*hits))
        left.append(q + at)
        right.append(v)
        while len(q):
            q, v = steps(q, v)
            pair = np.unique(q * n + v)
            q, v = pair // n, pair % n
            ok = ~seen[q, v]
            q, v = q[ok], v[ok]
            seen[q, v] = True
            hit = np.concatenate([np.einsum("pd,pd->p", Q[q[k : k + 100_000]], X[v[k : k + 100_000]]) >= floor for k in range(0, len(q), 100_000)]) if len(q) else np.zeros(0, bool)
            q, v = q[hit], v[hit]
            left.append(q + at)
            right.append(v)
    a, b = np.concatenate(left), np.concatenate(right)
    a, b = np.minimum(a, b), np.maximum(a, b)
    pair = np.unique(a[a != b] * n + b[a != b])
    return pair // n, pair % n


# --- shards of clusters


def centroids(rows: DataFrame, dim: int, k: int, fit_rows: int, n: int) -> np.ndarray:
    """``k`` unit vectors, fitted on the rows of lowest hash, about ``fit_rows`` of ``n``: some of these, moved to the mean of what is nearest."""
    share = min(1.0, fit_rows / n)
    some = rows.where(F.xxhash64("id") <= min(2**63 - 1, int(share * 2.0**64) - 2**63)).select("id", "vec").toArrow()
    X = matrix(some.column("vec"), dim)
    X = X[np.argsort(np.array(some.column("id").to_pylist(), object), kind="stable")]
    r = np.random.default_rng(0)
    C = X[r.permutation(len(X))[:k]].copy()
    for _ in range(6):
        c = np.concatenate([(X[at : at + 4096] @ C.T).argmax(axis=1) for at in range(0, len(X), 4096)])
        total = np.zeros((len(C), dim))
        np.add.at(total, c, X)
        size = np.linalg.norm(total, axis=1)
        C[size > 0] = total[size > 0] / size[size > 0][:, None]
    return C


def assigned(rows: DataFrame, C: np.ndarray, dim: int, overlap: int) -> DataFrame:
    """(cluster, id, vec): each row in the ``overlap`` clusters whose centroids are nearest."""
    m = min(overlap, len(C))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                near = np.argsort(-(matrix(some.column(1), dim) @ C.T), axis=1, kind="stable")[:, :m]
                k = pa.array(np.repeat(np.arange(len(some)), m))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), some.column(0).take(k), some.column(1).take(k)], ["cluster", "id", "vec"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "vec").mapInArrow(run, f"cluster long, id {kind}, vec array<float>")


def _pairs(rows: DataFrame, dim: int, n: int, floor: float, shard_rows: int, overlap: int, degree: int, alpha: float, beam: int, audit_rows: int, recall: float, centroid_bytes: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    k = max(1, min(-(-n // shard_rows), centroid_bytes // (4 * dim)))
    C = centroids(rows, dim, k, max(k, min(1 << 16, (1 << 25) // (4 * dim))), n)
    share = min(1.0, audit_rows / n)
    sample = rows.where(F.xxhash64("id", F.lit(1)) <= min(2**63 - 1, int(share * 2.0**64) - 2**63)).orderBy("id").collect()
    asked, S = [r["id"] for r in sample], np.array([r["vec"] for r in sample], np.float32).reshape(-1, dim)

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            X = matrix(batch.column(1), dim)
            x, y = np.nonzero(X @ S.T >= floor - 1e-5)
            ok = cosines(X, S, x, y) >= floor
            x, y = x[ok], y[ok]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(x)), pa.array([asked[j] for j in y], batch.schema.field(0).type)], ["x", "y"])

    truth = rows.select("id", "vec").mapInArrow(audit, f"x {kind}, y {kind}").where("x <> y") if asked else None
    truth = truth and written(truth.select(F.col("y").alias("asked"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "audit")
    while True:
        # a cluster of many rows, as of a large group, is cut into blocks of which each two are a shard
        parts = written(blocks(assigned(rows, C, dim, overlap), ["cluster"], F.lit(1), 4 * shard_rows, "id"), "parts")

        def build(table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            ids = table.column("id").combine_chunks()
            near = shard_graph(matrix(table.column("vec"), dim), degree, alpha, 2 * shard_rows)
            at = np.concatenate([[0], np.cumsum([len(x) for x in near])]).astype(np.int32)
            flat = ids.take(pa.array(np.concatenate(near).astype(np.int64) if at[-1] else np.zeros(0, np.int64)))
            return pa.table({"id": ids, "near": pa.ListArray.from_arrays(pa.array(at), flat)})

        shard = ["cluster", "lo", "hi"]
        graph = parts.groupBy(*shard).applyInArrow(build, f"id {kind}, near array<{kind}>")
        graph = graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

        def search(table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            ids, X = table.column("id").combine_chunks(), matrix(table.column("vec"), dim)
            place = {x: k for k, x in enumerate(ids.to_pylist())}
            near = [np.array([place[y] for y in x if y in place], np.int64) for x in table.column("near").to_pylist()]
            a, b = range_search(X, near, floor - 1e-5, beam)
            cos = cosines(X, X, a, b)
            ok = cos >= floor
            return pa.table({"a": ids.take(pa.array(a[ok])), "b": ids.take(pa.array(b[ok])), "cosine": pa.array(cos[ok])})

        found = parts.join(graph, "id").groupBy(*shard).applyInArrow(search, f"a {kind}, b {kind}, cosine double")
        found = written(found.groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "pairs")
        drop_written(parts)
        each = truth and truth.join(found, ["a", "b"], "left").groupBy("asked").agg(F.avg(F.col("cosine").isNotNull().cast("int")).alias("share"))
        got = each and each.agg(F.avg("share")).first()[0]
        if got is None or got >= recall:
            if truth:
                drop_written(truth)
            return found
        drop_written(found)
        if overlap >= len(C) and beam >= n:
            raise RuntimeError(f"the mean recall of the audited rows is {got:.3f}, and there is no more to search")
        overlap, beam = overlap + max(1, overlap // 2), beam * 2


def near_pairs(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", floor: float = 0.95, shard_rows: int = 800, overlap: int = 3, degree: int = 24, alpha: float = 1.2, beam: int = 16, audit_rows: int = 1024, recall: float = 0.95, centroid_bytes: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """((a, b, cosine), (id, first)): the pairs a < b of different vectors with a cosine of ``floor`` or more, with every row as a query; and the rows whose vector another one of smaller id has, with that id.

    Equal vectors are one node, whose id is the smallest. Vectors of each length are held against their like.

    1. Centroids are fitted on a sample of at most 65,536 rows or 32 MB; each row goes to its ``overlap`` nearest clusters of
       about ``shard_rows`` rows. Clusters are more than ``centroid_bytes`` allow for only beyond some 10^7 clusters x
       dimensions; they grow then. A cluster of over 4 ``shard_rows`` rows is cut into blocks, each two of them a shard.
    2. Build a robust-pruned graph on each shard and unite the lists of neighbours of each row over its shards.
    3. Search in each shard, over the united lists, from its medoid and the row's own neighbours (:func:`range_search`).
    4. Verify each pair by its cosine in double precision.
    5. Audit: compare about ``audit_rows`` rows with all rows by brute force. If of the pairs of an audited row, in the
       mean over those that have any, less than ``recall`` were found, repeat with more clusters for each row and
       twice the beam; if there is no more, fail.

    Null, empty, zero and non-finite vectors and null ids are in no pair; repeated rows of an id count once.
    """
    rows = usable(vectors, id_col, vec_col)
    rows = written(rows, "vectors")
    each = rows.groupBy("vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = written(each.select(F.col("first").alias("id"), "vec", "n", F.size("vec").alias("dim")), "nodes")
    copies = rows.join(nodes.where("n > 1").select("vec", F.col("id").alias("first")), "vec").where("id <> first").select("id", "first")
    none = nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine")).limit(0)
    how = (floor, shard_rows, overlap, degree, alpha, beam, audit_rows, recall, centroid_bytes)
    found = [_pairs(nodes.where(F.col("dim") == r["dim"]), r["dim"], r["count"], *how) for r in nodes.groupBy("dim").count().where("count > 1").collect()]
    return reduce(DataFrame.union, found, none), copies


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", **how) -> DataFrame:
    """(id, duplicate_of, links): each row of a group connected by :func:`near_pairs` but the first, with the group's smallest id and the number of different vectors within range of its own."""
    pairs, copies = near_pairs(vectors, id_col=id_col, vec_col=vec_col, **how)
    groups = components(pairs)
    links = pairs.select("a").union(pairs.select("b")).groupBy("a").count().select(F.col("a").alias("node"), F.col("count").alias("links"))
    nodes = groups.join(links, "node")
    own = nodes.where("node <> root").select("node", "root", "links")
    more = copies.join(nodes.withColumnRenamed("node", "first"), "first", "left").select(F.col("id").alias("node"), F.coalesce("root", "first").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    return own.union(more).select(F.col("node").alias(id_col), F.col("root").alias("duplicate_of"), "links")
