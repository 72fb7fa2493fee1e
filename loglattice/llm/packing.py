"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import column, written

#: permitted lengths, in tokens
CAPACITIES = (512, 1024, 2048, 4096)
#: a sequence of length L costs OVERHEAD + L + L²/ATTENTION
OVERHEAD, ATTENTION = 64, 16384


def cost(length: int) -> float:
    return OVERHEAD + length + length * length / ATTENTION


def _packed(sizes: list[int], capacities: tuple[int, ...], open_size) -> tuple[list[int], list[int]]:
    """(bin of each item, contents of each bin), for ``sizes`` in decreasing order."""
    at, used, room = [], [], []  # room: (space left, bin), sorted
    left = sum(sizes)
    for s in sizes:
        k = bisect_left(room, (s, -1))
        if k < len(room):
            space, b = room.pop(k)
        else:
            b, space = len(used), open_size(s, left)
            used.append(0)
        left -= s
        used[b] += s
        at.append(b)
        if space > s:
            insort(room, (space - s, b))
    return at, used


def best_fit(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, capacity of each bin, contents of each bin), for ``sizes`` in decreasing order.

    Each item goes where it leaves the least space. If it fits nowhere, the bin opened is the one of least cost: its
    own cost less what its free space is worth, at the best price for a token, as far as items are left to fill it.
    The same is done with one length alone wherever it is long enough, for each permitted length; of these packings
    the one of least cost is taken. Costs count each bin at the smallest permitted length that holds its contents, to
    which it is cut down at the end.
    """
    price = min(cost(c) / c for c in capacities)

    def joint(s: int, left: int) -> int:
        fits = [c for c in capacities if c >= s]
        return min(fits, key=lambda c: (cost(c) - price * min(c - s, left - s), c))

    rules = [joint] + [lambda s, left, c=c: next(x for x in capacities if x >= max(s, c)) for c in capacities]
    best = None
    for rule in rules:
        at, used = _packed(sizes, capacities, rule)
        final = [next(c for c in capacities if c >= u) for u in used]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = (total, at, final, used)
    return best[1:]


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(id_col).alias("doc_id"), F.xxhash64(column(text_col)).alias("text_hash"), column(text_col).alias("text")).where("text <> ''")


def _encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, keep: bool) -> DataFrame:
    """(doc_id, text_hash, size) of every row with text, and its tokens one after the other if they are to be kept."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = _width(vocabulary)
        for batch in batches:
            made = (list(tokens.encoded(t.as_py(), vocabulary)) for t in batch.column(2))
            rows = [(sum(map(len, parts)), np.concatenate(parts).astype(small).tobytes() if keep else None) for parts in made]
            cols = [pa.array([n for n, _ in rows], pa.int64()), *([pa.array([t for _, t in rows], pa.binary())] if keep else [])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "text_hash", "size", *(["tokens"] if keep else [])])

    return _keys(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, text_hash long, size long" + (", tokens binary" if keep else ""))


def _width(vocabulary: str) -> np.dtype:
    """The smallest integers that hold all tokens."""
    return np.dtype(np.uint16 if len(tokens.encoder(vocabulary)[1]) <= 1 << 16 else np.int32)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, shard_tokens: int = 16 << 20, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(bin, capacity, used, position, doc_id, text_hash, piece, start, length): where the tokens of every text go.

    Lengths are tokens of whole texts (:func:`loglattice.llm.tokens.encoded`). A text longer than the largest
    capacity is cut into pieces of that length and a rest; ``start`` is a piece's first token and ``position`` its
    place in the bin. :func:`sequences` puts the tokens there. Documents are spread by a hash of id, text and number of
    the copy over shards of about ``shard_tokens``, at any size of the input, and each shard is packed on its own: only
    lengths are shuffled, and no bin spans shards.

    Null and empty texts have no tokens and no row. Repeated rows are packed once for each row, null ids like others;
    both are spread over all shards. The same rows give the same bins.
    """
    return _placed(_encoded(docs, id_col, text_col, vocabulary, False), capacities, shard_tokens)


def _placed(sizes: DataFrame, capacities: tuple[int, ...], shard_tokens: int) -> DataFrame:
    """The result of :func:`pack` for (doc_id, text_hash, size) of every row."""
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    kind = sizes.schema["doc_id"].dataType
    sizes = written(sizes.groupBy("doc_id", "text_hash", "size").count(), "sizes")
    total = sizes.agg(F.sum(F.col("size") * F.col("count"))).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])
        items = []
        for k, n in enumerate(table.column("size").to_pylist()):
            items += [(min(most, n - a), k, a // most, a) for a in range(0, n, most)]
        items.sort(key=lambda x: (-x[0], x[1], x[2]))
        at, final, used = best_fit([x[0] for x in items], capacities)
        fill, position = [0] * len(final), []
        for (n, *_), b in zip(items, at):
            position.append(fill[b])
            fill[b] += n
        at = np.array(at, np.int64)
        n, k, piece, start = (np.array(x, np.int64) for x in zip(*items))
        cols = {"bin": shard << 32 | at, "capacity": np.array(final, np.int32)[at], "used": np.array(used, np.int32)[at], "position": np.array(position, np.int32)}
        kept = table.select(["doc_id", "text_hash"]).take(pa.array(k))
        return pa.table({**cols, "doc_id": kept.column(0), "text_hash": kept.column(1), "piece": piece.astype(np.int32), "start": start, "length": n.astype(np.int32)})

    spread = sizes.select("doc_id", "text_hash", "size", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("copy"))
    spread = spread.select("doc_id", "text_hash", "size", F.pmod(F.xxhash64("doc_id", "text_hash", "copy"), F.lit(shards)).cast("long").alias("shard"))
    schema = f"bin long, capacity int, used int, position int, doc_id {kind.simpleString()}, text_hash long, piece int, start long, length int"
    return spread.groupBy("shard").applyInArrow(run, schema)


def sequences(docs: DataFrame, placed: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, shard_tokens: int = 16 << 20, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(bin, capacity, doc_ids, tokens): the sequences that :func:`pack` laid out, with the ids of the documents in them.

    Each row is encoded once; without ``placed`` the sizes are those of what was encoded. Tokens are shuffled twice:
    to the places of their document, where repeated rows become one, and in pieces, of which none is longer than a
    sequence, to their bins. The places of one document in one shard come together, no more than a shard has.
    Rows without text have no part in it; repeated rows are there as often as placed.
    """
    kind = docs.schema[id_col].dataType
    coded = _encoded(docs, id_col, text_col, vocabulary, True)
    if placed is None:
        coded = written(coded, "encoded")
        placed = _placed(coded.select("doc_id", "text_hash", "size"), capacities, shard_tokens)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(vocabulary).itemsize
        for batch in batches:
            places = batch.column(0)
            row = np.repeat(np.arange(len(batch)), np.diff(places.offsets.to_numpy()))
            place = places.flatten()
            b, capacity, position, ids, start, length = (place.field(k) for k in range(6))
            data = batch.column(1).to_pylist()
            pieces = [data[k][width * a : width * (a + n)] for k, a, n in zip(row, start.to_numpy(), length.to_numpy())]
            yield pa.RecordBatch.from_arrays([b, capacity, position, ids, pa.array(pieces, pa.binary())], ["bin", "capacity", "position", "doc_id", "tokens"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bin and position, so that the tokens of a batch stand as they are to be; only bins are to be told apart."""
        held: pa.Table | None = None
        small = _width(vocabulary)

        def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not len(table):
                return
            table = table.combine_chunks()
            bins = table.column("bin").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
            data = table.column("tokens").to_pylist()
            at = np.concatenate([[0], np.cumsum([len(x) // small.itemsize for x in data])])[np.append(first, len(data))]
            ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(data)), pa.int32()), table.column("doc_id").combine_chunks())
            flat = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(data), small).astype(np.int32)))
            some = table.select(["bin", "capacity"]).take(pa.array(first)).combine_chunks()
            yield from pa.table([*some.columns, ids, flat], ["bin", "capacity", "doc_ids", "tokens"]).to_batches()

        for batch in batches:
            if len(batch):
                held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
                bins = held.column("bin").to_numpy()
                last = int(np.searchsorted(bins, bins[-1]))
                yield from made(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield from made(held)

    # a null id is a value here, so that both sides are joined by a hash of the id; what has the same text has the same tokens
    key = F.xxhash64("doc_id").alias("k")
    places = placed.groupBy(key, "text_hash", F.shiftright("bin", 32).alias("shard")).agg(F.collect_list(F.struct("bin", "capacity", "position", "doc_id", "start", "length")).alias("places"))
    coded = coded.select(key, "text_hash", "tokens").dropDuplicates(["k", "text_hash"])
    pieces = places.join(coded, ["k", "text_hash"]).select("places", "tokens").mapInArrow(cut, f"bin long, capacity int, position int, doc_id {kind.simpleString()}, tokens binary")
    rows = pieces.repartition("bin").sortWithinPartitions("bin", "position").select("bin", "capacity", "doc_id", "tokens")
    return rows.mapInArrow(joined, f"bin long, capacity int, doc_ids array<{kind.simpleString()}>, tokens array<int>")
