"""Near-duplicate search over SimHash signatures by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, blocks, column, components, fresh, mixed, shingles, written

BITS = 64
#: bytes of a sketch
SLOTS = 128
#: rows of one key up to which they are compared by neighbours, and as many rows show whether a longer run is dense
SHORT = 64
#: neighbours of a row, under one key, from which its pairs aren't listed
DENSE = 8
#: microseconds for a row through the shuffle and for a comparison of two signatures, in the cost of a plan
ROW_COST, PAIR_COST = 1.5, 0.006


# --- signatures


class _Signs:
    """±1 rows for words, made once for each word."""

    def __init__(self, limit: int = 100_000):
        self.limit, self.rows, self.table = limit, {}, np.empty((1024, BITS), np.int8)
        self.hashes = WordHashes()

    def of(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.rows]
        if new:
            if len(self.rows) + len(new) > self.limit:
                self.rows.clear()
                new = words
            start = len(self.rows)
            while start + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            bits = np.unpackbits(mixed(self.hashes.of(new)).view(np.uint8).reshape(-1, 8), axis=1)
            self.table[start : start + len(new)] = bits.astype(np.int8) * 2 - 1
            self.rows.update(zip(new, range(start, start + len(new))))
        return self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]


def signature(words: list[str], signs: _Signs) -> int:
    """64 bits: for each, whether more of the distinct words vote for it than against."""
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(words), 50_000):
        votes += signs.of(words[k : k + 50_000]).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes > 0).view(np.int64)[0])


def sketch(grams: np.ndarray) -> np.ndarray:
    """SLOTS bytes: of the hashes that begin with each 7 bits the least one's next byte, never 0; 0 where there is none.

    For two sets the share of equal slots, among those filled in either, estimates their Jaccard index.
    """
    out = np.zeros(SLOTS, np.uint8)
    h = np.sort(grams)
    slot = (h >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    out[slot[first]] = 1 + (h[first] >> np.uint64(20)) % np.uint64(255)
    return out


def alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sketches (rows of a and b) allow a Jaccard index of ``least``: no more than 5 standard deviations below it."""
    same = ((a == b) & (a > 0)).sum(axis=1)
    both = ((a | b) > 0).sum(axis=1)
    return same >= least * both - 5 * np.sqrt(both * least * (1 - least))


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, t, sig, h1, h2, n, sketch): SimHash of the distinct lower-case words, 128 bits of hash of the words in order,
    their number, and the :func:`sketch` of their runs. ``t`` tells the texts of one id apart.

    Documents without an id, without text or without words have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = _Signs()
        for batch in batches:
            sig, n, h, marks = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), np.zeros((len(batch), 2), np.int64), np.zeros((len(batch), SLOTS), np.uint8)
            for k, text in enumerate(batch.column(2)):
                words = text.as_py().lower().split()
                if words:
                    n[k] = len(words)
                    h[k] = np.frombuffer(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")), np.int64)
                    sig[k] = signature(list(set(words)), signs)
                    marks[k] = sketch(shingles(signs.hashes.of(words), shingle))
            at = pa.py_buffer(np.arange(0, len(batch) * SLOTS + 1, SLOTS, dtype=np.int32).tobytes())
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, at, pa.py_buffer(marks.tobytes())])
            cols = [batch.column(0), batch.column(1), *map(pa.array, (sig, h[:, 0].copy(), h[:, 1].copy(), n)), packed]
            yield pa.RecordBatch.from_arrays(cols, ["id", "t", "sig", "h1", "h2", "n", "sketch"]).filter(pa.array(n > 0))

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, t long, sig long, h1 long, h2 long, n long, sketch binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = column(text_col)
    return docs.select(column(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text")).where("id is not null and text is not null")


# --- the plan: which bits make a partition, and which threshold each gets


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """(n, 64×64 counts of how often two bits are both set), over all signatures."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["at", "n"])

    rows = nodes.select("sig").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for at, n in rows:
        flat[at] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in ``m`` partitions, the ones that correlate most in the same one."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for g in range(m):
        width = len(left) // (m - g)
        seed = max(left, key=lambda b: (corr[b, left].sum(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < width:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def within(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated shares of random pairs whose distance in this partition is at most 0, 1, … ``most``.

    The mean and variance of the distance follow exactly from the counts of single bits and of pairs of bits; a
    beta-binomial distribution is fitted to them.
    """
    w, total = len(group), max(n, 1)
    p11 = both[np.ix_(group, group)] / total
    p = np.diag(p11)
    p10 = p[:, None] - p11
    p00 = 1 - p[:, None] - p[None, :] + p11
    differ = 2 * p * (1 - p)
    joint = 2 * (p11 * p00 + p10 * p10.T)
    np.fill_diagonal(joint, differ)
    mean, var = differ.sum(), (joint - np.outer(differ, differ)).sum()
    mu = min(max(mean / w, 1e-6), 1 - 1e-6)
    plain = w * mu * (1 - mu)
    rho = min(max((var / plain - 1) / (w - 1), 1e-6), 0.99) if w > 1 else 1e-6
    a, b = mu * (1 / rho - 1), (1 - mu) * (1 / rho - 1)
    ln = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    mass = [math.exp(math.lgamma(w + 1) - math.lgamma(k + 1) - math.lgamma(w - k + 1) + ln(k + a, w - k + b) - ln(a, b)) for k in range(most + 1)]
    return list(np.minimum(1, np.cumsum(mass)))


def allocated(n: int, both: np.ndarray, tau: int, most: int = 4) -> list[tuple[list[int], int]]:
    """[(bits, threshold)]: thresholds t with the sum of t + 1 equal to tau + 1, at the least estimated cost.

    Two signatures within ``tau`` differ in at most t bits in some partition, or the sum of their distances would be
    tau + 1 at least. Dynamic programming over partitions and what is left to allocate finds the best thresholds for
    each number of partitions; the cheapest number wins. A threshold of -1 leaves a partition out.
    """
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, 9):
        groups = grouped_bits(n, both, m)
        costs = []
        for g in groups:
            share, cost = within(n, both, g, most), [0.0]
            for t in range(min(most, len(g)) + 1):
                rows = sum(math.comb(len(g), d) for d in range((t + 1) // 2 + 1))
                cost.append(n * rows * ROW_COST + n * n / 2 * share[t] * (1 if t == 0 else 2) * PAIR_COST)
            costs.append(cost)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for used, (c, chosen) in table.items():
                for add, more in enumerate(cost):
                    if used + add <= tau + 1 and (used + add not in new or c + more < new[used + add][0]):
                        new[used + add] = (c + more, [*chosen, add - 1])
            table = new
        if tau + 1 in table and (best is None or table[tau + 1][0] < best[0]):
            best = (table[tau + 1][0], [(g, t) for g, t in zip(groups, table[tau + 1][1]) if t >= 0])
    assert best is not None, "no allocation reaches this distance"
    return best[1]


# --- probing


def _parts(sig: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of one partition, packed."""
    sig = sig.view(np.uint64)
    out = np.zeros(len(sig), np.int64)
    for k, b in enumerate(group):
        shift = np.uint64(8 * (b // 8) + 7 - b % 8)
        out |= ((sig >> shift) & np.uint64(1)).astype(np.int64) << k
    return out


def _masks(width: int, radius: int) -> np.ndarray:
    masks = [0]
    for d in range(1, radius + 1):
        from itertools import combinations

        masks += [sum(1 << k for k in c) for c in combinations(range(width), d)]
    return np.array(masks, np.int64)


def probes(nodes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(key, sig, nid): each signature under each value within ⌈t/2⌉ of its own in each partition.

    Two signatures within t in a partition have a value in common, halfway between them.
    """
    variants = [_masks(len(g), (t + 1) // 2) for g, t in plan]
    each = sum(map(len, variants))

    def run(batches):
        for batch in batches:
            step = max(1, 200_000 // each)
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                sig, nid = (part.column(c).to_numpy(zero_copy_only=False) for c in (1, 0))
                keys = np.concatenate([(_parts(sig, g)[:, None] ^ v[None, :]) * 8 + k for k, ((g, _), v) in enumerate(zip(plan, variants))], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(sig, each)), pa.array(np.repeat(nid, each))], ["key", "sig", "nid"])

    return nodes.select("nid", "sig").mapInArrow(run, "key long, sig long, nid long")


def _canonical(plan, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the keys under which a pair meets, one: in the first partition that matches, the one nearest to the lesser."""
    which, ok, done = key % 8, np.zeros(len(key), bool), np.zeros(len(key), bool)
    for k, (g, t) in enumerate(plan):
        pa_, pb = _parts(a, g), _parts(b, g)
        x = pa_ ^ pb
        d = np.bitwise_count(x.view(np.uint64)).astype(np.int64)
        hit = (d <= t) & ~done
        low = np.minimum(pa_, pb)
        # flip the lower half of the differing bits in the lesser value, one at a time
        mid, rest = low.copy(), x.copy()
        for j in range((t + 1) // 2):
            bit = np.where(j < d // 2, rest & -rest, 0)
            mid ^= bit
            rest ^= bit
        ok |= hit & (which == k) & (key // 8 == mid)
        done |= hit
    return ok


def _within(key: np.ndarray, sig: np.ndarray, left: np.ndarray, right: np.ndarray, plan, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in left, j in right) of one key's rows within ``tau`` of which the key is the canonical one; i < j if both are the same."""
    out = [(np.zeros(0, np.int64),) * 2]
    step = max(1, 250_000 // max(1, len(right)))
    for at in range(0, len(left), step):
        others = right[at:] if left is right else right
        i, j = np.nonzero(np.bitwise_count((sig[left[at : at + step], None] ^ sig[None, others]).view(np.uint64)) <= tau)
        i, j = left[at + i], others[j]
        ok = i < j if left is right else np.ones(len(i), bool)
        i, j = i[ok], j[ok]
        ok = _canonical(plan, key[i], sig[i], sig[j])
        out.append((i[ok], j[ok]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _compared(key: np.ndarray, sig: np.ndarray, plan, tau: int, dense: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of rows of one key within ``tau`` of which the key is the canonical one, i < j, and places of the rows of dense keys, which aren't compared.

    Rows come sorted by key. In short runs of one key a row is compared with the next one, then with the one after
    that, and so on, by whole arrays at once; long runs are compared by blocks. A long run is dense if a sample of its
    rows has more than ``dense`` neighbours each; 0: none is.
    """
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    left, right, whole = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, end = np.arange(len(key)), np.repeat(start + size, size)
    at = at[np.repeat(size <= SHORT, size)]
    lag = 1
    while len(at):
        at = at[at + lag < end[at]]
        near = at[np.bitwise_count((sig[at] ^ sig[at + lag]).view(np.uint64)) <= tau]
        if len(near):
            near = near[_canonical(plan, key[near], sig[near], sig[near + lag])]
            left.append(near)
            right.append(near + lag)
        lag += 1
    for k in np.flatnonzero(size > SHORT):
        run = np.arange(start[k], start[k] + size[k])
        some = run[:: max(1, len(run) // SHORT)]
        if dense and (np.bitwise_count((sig[some, None] ^ sig[None, run]).view(np.uint64)) <= tau).sum() > (dense + 1) * len(some):
            whole.append(run)
            continue
        i, j = _within(key, sig, run, run, plan, tau)
        left.append(i)
        right.append(j)
    return tuple(map(np.concatenate, (left, right, whole)))


def _searched(nodes: DataFrame, plan: list[tuple[list[int], int]], tau: int, hot_rows: int, dense: int) -> tuple[DataFrame, DataFrame | None]:
    """((key, a, b), hot): pairs within ``tau``, each once, under key -1; rows of dense keys, as a and b, under their key. The rows of hot keys aren't among them.

    A key is hot if it has more than about ``hot_rows`` rows, as one node in 64 shows; hot is (key, sig, nid, lo, hi, side): the rows in blocks by a hash, each two of which are a group.
    """
    probed = probes(nodes, plan)

    def compare(table: pa.Table) -> pa.Table:
        key, sig = (table.column(c).to_numpy() for c in (0, 1))
        nid = table.column(2).to_numpy()
        i, j, whole = _compared(key, sig, plan, tau, dense)
        return pa.table({"key": np.concatenate([np.full(len(i), -1), key[whole]]), "a": nid[np.concatenate([i, whole])], "b": nid[np.concatenate([j, whole])]})

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if held and len(batch):
                keys = batch.column(0).to_numpy()
                last = held[-1].column(0)[-1].as_py()
                cut = int(np.searchsorted(keys, last, "right"))
                if cut < len(batch) and rows + cut >= 100_000:
                    held.append(batch.slice(0, cut))
                    yield from compare(pa.Table.from_batches(held)).to_batches()
                    held, rows, batch = [], 0, batch.slice(cut)
            if len(batch):
                held.append(batch)
                rows += len(batch)
        if held:
            yield from compare(pa.Table.from_batches(held)).to_batches()

    cold, rows = probed, None
    some = nodes.where(F.pmod(F.xxhash64("nid"), F.lit(64)) == 0)
    hot = written(probes(some, plan).groupBy("key").count().where(F.col("count") > max(1, hot_rows // 64)).select("key", F.ceil(F.col("count") * 64 / hot_rows).alias("m")), "hot")
    if not hot.isEmpty():
        cold = probed.join(hot, "key", "left_anti")
        rows = probed.join(hot, "key").withColumn("block", F.pmod(F.xxhash64("nid", F.lit(1)), F.col("m")))
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
        side = F.when(F.col("block") == F.col("j"), -1).when(F.col("block") < F.col("j"), 0).otherwise(1)
        rows = rows.select("key", "sig", "nid", F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("hi"), side.alias("side"))
    found = cold.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, a long, b long")
    return found.select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), rows


def close_pairs(nodes: DataFrame, plan: list[tuple[list[int], int]], tau: int, hot_rows: int = 1 << 16) -> DataFrame:
    """(a, b): nids of the signatures within ``tau``, each pair once, a < b."""

    def cross(table: pa.Table) -> pa.Table:
        key, sig, side = (table.column(c).to_numpy() for c in ("key", "sig", "side"))
        left = np.flatnonzero(side <= 0)
        right = left if len(left) and side[left[0]] < 0 else np.flatnonzero(side > 0)
        i, j = _within(key, sig, left, right, plan, tau)
        return pa.table({"a": table.column("nid").take(pa.array(i)), "b": table.column("nid").take(pa.array(j))})

    found, hot = _searched(nodes, plan, tau, hot_rows, 0)
    pairs = found.select("a", "b")
    if hot is not None:
        pairs = pairs.union(hot.groupBy("key", "lo", "hi").applyInArrow(cross, "a long, b long"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def forest(sig: np.ndarray, marks: np.ndarray, tau: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) within ``tau`` whose sketches allow a Jaccard index of ``least``, one less than rows for each set of rows that all such pairs connect."""
    left, right, todo = [], [], np.arange(len(sig))
    while len(todo):
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            i = front.pop()
            at = np.flatnonzero(np.bitwise_count((sig[i] ^ sig[todo]).view(np.uint64)) <= tau)
            at = at[alike(marks[i : i + 1], marks[todo[at]], least)]
            if len(at):
                left.append(np.full(len(at), i))
                right.append(todo[at])
                front.extend(todo[at])
                todo = np.delete(todo, at)
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))


def connections(nodes: DataFrame, plan: list[tuple[list[int], int]], tau: int, least: float, hot_rows: int = 1 << 16, dense: int = DENSE) -> DataFrame:
    """(a, b): pairs within ``tau`` whose sketches allow a Jaccard index of ``least``. What all such pairs connect, these do.

    Large groups of near copies have pairs by the square of their size. Under keys where a row has more than ``dense``
    neighbours only the rows are given; they meet again with their sketches, and pairs that connect them are enough.
    """

    def trees(table: pa.Table) -> pa.Table:
        nid, at = np.unique(table.column("nid").to_numpy(), return_index=True)
        table = table.take(pa.array(at))
        i, j = forest(table.column("sig").to_numpy(), _marks(table.column("sketch")), tau, least)
        return pa.table({"a": nid[i], "b": nid[j]})

    found, hot = _searched(nodes, plan, tau, hot_rows, dense)
    found = written(found, "near")
    rows = found.where("key >= 0").select("key", F.col("a").alias("nid"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    if hot is not None:
        rows = rows.union(hot.select("key", "nid", "lo", "hi"))
    met = rows.join(nodes.select("nid", "sig", "sketch"), "nid").groupBy("key", "lo", "hi").applyInArrow(trees, "a long, b long")
    return plausible(found.where("key < 0").select("a", "b"), nodes, least).union(met)


# --- verification


def _marks(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, SLOTS)


def plausible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs whose sketches allow a Jaccard index of ``least``. What is within reach by chance goes here, before
    pairs are connected: else, from some 10^8 documents on, chance alone would connect most of them.
    """

    def run(batches):
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(alike(_marks(batch.column(2)), _marks(batch.column(3)), least)))

    side = lambda x: nodes.select(F.col("nid").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a long, b long")


class Shared:
    """How many elements, small numbers, two different sets have in common: for some sets against others, by whole blocks.

    Elements of many sets are columns of a matrix that is multiplied with itself; of the others the sets that have
    one are listed.
    """

    def __init__(self, sets: list[np.ndarray]):
        row, flat = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        count = np.bincount(flat)
        # an element of one set alone is in no intersection; a sum of the matrix product costs a 200th of an entry in a list
        many = (count > 1) & (count.astype(float) ** 2 > len(sets) ** 2 / 200)
        at = many[flat]
        self.matrix = np.zeros((len(sets), int(many.sum())), np.uint8)
        self.matrix[row[at], (np.cumsum(many) - 1)[flat[at]]] = 1
        at = (count > 1)[flat] & ~at
        self.flat = flat[at]
        self.first = np.searchsorted(row[at], np.arange(len(sets) + 1))
        order = np.argsort(self.flat, kind="stable")
        self.row = row[at][order].astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.flat, minlength=len(count)))])

    def of(self, low: int, high: int, begin: int, end: int) -> np.ndarray:
        """Counts for sets low to high against sets begin to end."""
        width = end - begin
        total = np.zeros((high - low, width), np.float32)
        step = max(1, 8_000_000 // max(1, width, high - low))
        for k in range(0, self.matrix.shape[1], step):
            m = self.matrix[:, k : k + step]
            total += m[low:high].astype(np.float32) @ m[begin:end].astype(np.float32).T
        flat = self.flat[self.first[low] : self.first[high]]
        mine = np.repeat(np.arange(high - low), np.diff(self.first[low : high + 1]))
        size = self.start[flat + 1] - self.start[flat]
        ends = np.cumsum(size)
        k = 0
        while k < len(flat):  # as many entries at a time as fit
            to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + 4_000_000, "right")))
            n = size[k:to]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[flat[k:to]], n)
            col = self.row[at]
            ok = (col >= begin) & (col < end)
            total += np.bincount(np.repeat(mine[k:to], n)[ok] * width + (col[ok] - begin), minlength=total.size).reshape(total.shape)
            k = to
        return total


def _verified(texts: DataFrame, nodes: DataFrame, roots: DataFrame, tau: int, k: int, least: float, block_words: int, counted: bool) -> DataFrame:
    """(nid, other, links): for each node of a group its number of links, at distance ``tau`` and Jaccard ``least``, to nodes of the same group, and nodes that connect what is linked.

    A group of more than ``block_words`` words is cut into blocks by a hash; each two blocks are a task's work. Unless
    links are ``counted``, pairs that others connect already aren't verified, and links are at least 1.
    """

    def run(table: pa.Table) -> pa.Table:
        nid, at = np.unique(table.column("nid").to_numpy(), return_index=True)
        at = at[np.argsort(table.column("side").to_numpy()[at], kind="stable")]
        table = table.take(pa.array(at))
        nid = table.column("nid").to_numpy()
        sig, side, texts = table.column("sig").to_numpy(), table.column("side").to_numpy(), table.column("text")
        words = WordHashes()
        sets = [np.unique(shingles(words.of(t.as_py().lower().split()), k)) for t in texts]
        size = np.array([len(x) for x in sets])
        # hashes as small numbers, in their order
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        sets = np.split(flat, np.cumsum(size)[:-1])
        root, links = np.arange(len(nid)), np.zeros(len(nid), np.int64)
        shared, one = Shared(sets), side[0] < 0
        rows = len(nid) if one else int((side == 0).sum())
        step = max(1, min(2_000_000 // len(nid), 256))
        for a in range(0, rows, step):
            end, begin = min(a + step, rows), a if one else rows
            near = np.bitwise_count((sig[a:end, None] ^ sig[None, begin:]).view(np.uint64)) <= tau
            i, j = np.nonzero(np.triu(near, 1) if one else near)
            if not counted:
                apart = root[a + i] != root[begin + j]
                i, j = i[apart], j[apart]
            if not len(i):
                continue
            both, i, j = shared.of(a, end, begin, len(nid))[i, j].astype(np.int64), i + a, j + begin
            ok = both >= least * (size[i] + size[j] - both)
            i, j = i[ok], j[ok]
            links += np.bincount(i, minlength=len(nid)) + np.bincount(j, minlength=len(nid))
            while True:  # each node takes the least root of those linked to it, until none changes
                low = np.minimum(root[i], root[j])
                new = root.copy()
                np.minimum.at(new, root[i], low)
                np.minimum.at(new, root[j], low)
                new = new[new]
                if np.array_equal(new, root):
                    break
                root = new
        at = np.flatnonzero(links)
        return pa.table({"nid": nid[at], "other": nid[root[at]], "links": links[at]})

    own = nodes.join(roots, nodes["nid"] == roots["node"]).select("nid", "sig", "id", "t", "n", "root")
    own = blocks(own, ["root"], F.col("n"), block_words, "nid")
    rows = texts.join(own, ["id", "t"]).select("root", "lo", "hi", "side", "nid", "sig", "text")
    return rows.groupBy("root", "lo", "hi").applyInArrow(run, "nid long, other long, links long")


def _copies(docs: DataFrame, id_col: str, text_col: str, tau: int, shingle: int, least: float, block_words: int, counted: bool = True) -> DataFrame:
    """(id, t, first, links) of the documents that aren't the first of their group; ``t`` is the hash of the text."""
    signed = written(signatures(docs, id_col, text_col, shingle), "signatures")
    nodes = signed.groupBy("sig", "h1", "h2").agg(F.min(F.struct("id", "t")).alias("own"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("nid"), "sig", "h1", "h2", "own.id", "own.t", "n", "sketch"), "nodes")
    n, both = bit_statistics(nodes)
    if n > 1:
        pairs = connections(nodes, allocated(n, both, tau), tau, least)
        roots = components(pairs)
        found = written(_verified(_texts(docs, id_col, text_col), nodes, roots, tau, shingle, least, block_words, counted), "links")
        groups = components(found.select("nid", "other"), "nid", "other")
        links = found.groupBy("nid").agg(F.sum("links").alias("links"))
        known = nodes.join(links, "nid", "left").join(groups, nodes["nid"] == groups["node"], "left").select("sig", "h1", "h2", "id", "t", F.coalesce("root", "nid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
        first = known.groupBy("root").agg(F.min(F.struct("id", "t")).alias("own"))
        known = known.join(first, "root").select("sig", "h1", "h2", "links", "own")
    else:
        known = nodes.select("sig", "h1", "h2", F.lit(0).cast("long").alias("links"), F.struct("id", "t").alias("own"))
    rows = signed.select("id", "t", "sig", "h1", "h2").join(known, ["sig", "h1", "h2"])
    return rows.where("id <> own.id or t <> own.t").select("id", "t", F.col("own.id").alias("first"), "links").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tau: int = 10, shingle: int = 3, least: float = 0.45, block_words: int = 4_000_000) -> DataFrame:
    """(id, duplicate_of, links): each document that belongs to a group of near duplicates but isn't its first, with the group's smallest id, and the number of other texts that its own is linked to.

    Two texts are near duplicates if their 64-bit SimHash signatures differ in at most ``tau`` bits and the Jaccard
    index of their sets of runs of ``shingle`` lower-case words is ``least`` or more; groups are what such links
    connect. The search for pairs within ``tau`` is exact, for every document against every other.

    1. Sign every document; documents with the same words in the same order are one node.
    2. Count over all signatures how often each two bits are set together; put correlated bits into one partition.
    3. Allocate thresholds to the partitions by dynamic programming on estimated candidates (:func:`allocated`).
    4. Probe and compare; pairs whose sketches rule the Jaccard index out go (at the threshold 3 in 10^7 wrongly).
    5. Verify on whole texts, within what the remaining pairs connect; connect the verified links.

    Null or empty texts and null ids are never near duplicates. Rows with the same id and text are one document;
    different texts of one id are documents of their own, and the one whose hash is less comes first.
    """
    found = _copies(docs, id_col, text_col, tau, shingle, least, block_words)
    return found.select(F.col("id").alias(id_col), F.col("first").alias("duplicate_of"), "links")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tau: int = 10, shingle: int = 3, least: float = 0.45, block_words: int = 4_000_000) -> DataFrame:
    """``docs`` without the documents that :func:`near_duplicates` reports, by id and text: one text of each group stays."""
    i, t = fresh(docs, "_gone_id"), fresh(docs, "_gone_t")
    gone = _copies(docs, id_col, text_col, tau, shingle, least, block_words, counted=False).select(F.col("id").alias(i), F.col("t").alias(t))
    return docs.join(gone, (column(id_col) == column(i)) & (F.xxhash64(column(text_col)) == column(t)), "left_anti")
