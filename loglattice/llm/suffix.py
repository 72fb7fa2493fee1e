"""Passages that repeat, found with suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, column, mixed, written

#: words that decide about one anchor
GRAM = 16


# --- suffix arrays


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text``, small non-negative numbers, in order.

    Larsson and Sadakane's refinement: suffixes sorted by their first h symbols are sorted by 2h, with the ranks of
    the suffixes h further on as keys. Groups of one are done and aren't looked at again.
    """
    n = len(text)
    sa = np.argsort(text, kind="stable")
    head = np.concatenate([[True], text[sa][1:] != text[sa][:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 1
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(open_):
        group = rank[sa[open_]]
        beyond = sa[open_] + h
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = group * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        sa[open_] = sa[open_][order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[sa[open_]] = np.maximum.accumulate(np.where(first, open_, 0))
        open_ = open_[~(first & np.append(first[1:], True))]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix, in order, with the one before it.

    Kasai's scan in the order of the text, without the loop: where a suffix and its predecessor follow equal symbols, the
    length is one less than that of the suffix one symbol earlier; only elsewhere are symbols compared.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    prior = np.where((at > 0) & (before > 0), text[np.maximum(before - 1, 0)], -1)
    derived = (at > 0) & (before > 0) & (text[at - 1] == prior)
    start = np.flatnonzero(~derived)
    length = np.zeros(len(start), np.int64)
    live = np.flatnonzero(before[start] >= 0)
    a, b = start[live], before[start[live]]
    while len(live):
        ok = (a < n) & (b < n)
        ok[ok] = text[a[ok]] == text[b[ok]]
        live, a, b = live[ok], a[ok] + 1, b[ok] + 1
        length[live] += 1
    ends = np.zeros(n, np.int64)
    ends[start] = start + length
    return (np.maximum.accumulate(ends) - at)[sa]


# --- anchors


def grams(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM words."""
    h, k = words, 1
    with np.errstate(over="ignore"):
        while k < GRAM:
            h = mixed(h[: max(0, len(h) - k)] * np.uint64(31) + h[k:] + np.uint64(k))
            k *= 2
    return h


def anchors(g: np.ndarray, window: int) -> np.ndarray:
    """For each window of ``window`` words the place of the least of its grams, the first one of equals.

    Equal windows have their anchors at the same place in them.
    """
    w = window - GRAM + 1
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value, place, k = g, np.arange(len(g)), 1

    def least(step: int, length: int):
        a, b = value[:length], value[step : step + length]
        left = a <= b
        return np.where(left, a, b), np.where(left, place[:length], place[step : step + length])

    while 2 * k <= w:
        value, place = least(k, len(value) - k)
        k *= 2
    if k < w:
        value, place = least(w - k, n)
    return place


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(route, known, id, t, pos): every anchor of every document once.

    ``route`` is the anchor's key. Of a key that a batch holds several times only the first row goes there; the others,
    known to be shared, are routed by another hash, so that a passage in most documents doesn't fill one task.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, places, rows = [], [], []
            for k, text in enumerate(batch.column(2)):
                g = grams(hashes.of(text.as_py().split()))
                at = np.unique(anchors(g, window))
                keys.append(g[at])
                places.append(at)
                rows.append(np.full(len(at), k))
            if rows:
                key, place, row = (np.concatenate(x) for x in (keys, places, rows))
                _, first, which, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                known = n[which] > 1
                other = known & (first[which] != np.arange(len(key)))
                with np.errstate(over="ignore"):
                    route = np.where(other, mixed(key + place.astype(np.uint64) * np.uint64(31) + mixed(row.astype(np.uint64))), key)
                where = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(known), batch.column(0).take(where), batch.column(1).take(where), pa.array(place.astype(np.int32))], ["route", "known", "id", "t", "pos"])

    return docs.mapInArrow(run, f"route long, known boolean, id {kind}, t long, pos int")


def _blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of about ``least`` rows whose first column, which is sorted, has no value in two of them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if held and len(batch) and rows >= least:
            last = held[-1].column(0)[-1].as_py()
            cut = int(np.searchsorted(batch.column(0).to_numpy(zero_copy_only=False), last, "right"))
            if cut < len(batch):
                held.append(batch.slice(0, cut))
                yield pa.Table.from_batches(held)
                held, rows, batch = [], 0, batch.slice(cut)
        if len(batch):
            held.append(batch)
            rows += len(batch)
    if held:
        yield pa.Table.from_batches(held)


def _shared(rows: DataFrame) -> DataFrame:
    """(id, t, pos) of the anchors whose key more than one row has; no more than a batch is held at a time."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shown = None, False
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            key, known = (table.column(c).to_numpy() for c in ("route", "known"))
            same = key[1:] == key[:-1]
            more = known | np.append(same, False) | np.concatenate([[False], same])
            show = more.copy()
            if last is not None and shown:
                show[0] = False
            yield from table.select(["id", "t", "pos"]).filter(pa.array(show)).to_batches()
            last, shown = table.slice(len(table) - 1).to_batches()[0], bool(more[-1])

    return rows.repartition("route").sortWithinPartitions("route").mapInArrow(run, f"id {kind}, t long, pos int")


# --- shards


def _runs(doc: np.ndarray, pos: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, count) of stretches of rows with following positions, one document and one first document."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (first[1:] != first[:-1])
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(doc)))


def ranked(names: dict[str, int]) -> np.ndarray:
    """Places of the words in their own order, by the numbers they have in ``names``."""
    out = np.empty(len(names), np.int64)
    out[np.array([names[w] for w in sorted(names)], np.int64)] = np.arange(len(names))
    return out


def shard_repeats(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], window: int):
    """Repeats inside of one shard: ``docs`` are (words as numbers in their own order, their hashes, shared anchor places), in the order of their ids.

    Returns (doc, pos, first doc) of each window that an earlier one equals, as arrays, and (doc, pos, anchor key,
    rank in the suffix array) of each window that none does: the shard's representatives, for the merge with the
    other shards. Hashes say only where to look; words are compared.
    """
    pieces, where, owner, valid_at, keys, texts = [], [], [], [], [], []
    total = 0
    for d, (words, hashed, places) in enumerate(docs):
        g = grams(hashed)
        place = anchors(g, window)
        asked = np.flatnonzero(np.isin(place, places))
        if not len(asked):
            continue
        keys.append(g[place[asked]])
        # stretches of words covered by these windows
        new = np.concatenate([[True], asked[1:] > asked[:-1] + window])
        begin, stop = asked[new], asked[np.append(np.flatnonzero(new)[1:] - 1, len(asked) - 1)] + window
        which = np.cumsum(new) - 1
        size = stop - begin + 1  # and a separator
        base = total + np.cumsum(size) - size
        valid_at.append(base[which] + asked - begin[which])
        where.append(asked)
        owner.append(np.full(len(asked), d))
        for a, b in zip(begin, stop):
            texts.append(words[a:b])
            pieces.append(b - a)
        total += int(size.sum())
    if not total:
        e = np.zeros(0, np.int64)
        return (e, e, e), (e, e, e.view(np.uint64), e)
    size = np.array(pieces)
    _, small = np.unique(np.concatenate(texts), return_inverse=True)
    stream = np.empty(total, np.int64)
    end = np.cumsum(size + 1) - 1
    inside = np.ones(total, bool)
    inside[end] = False
    stream[inside] = small
    stream[end] = small.max() + 1 + np.arange(len(end))
    sa = suffix_array(stream)
    same = common_prefixes(stream, sa) >= window
    at, pos, doc = np.concatenate(valid_at), np.concatenate(where), np.concatenate(owner)
    window_of = np.full(total, -1)
    window_of[at] = np.arange(len(at))
    rank = np.empty(total, np.int64)
    rank[sa] = np.arange(total)
    group = np.flatnonzero(~same)
    least = np.minimum.reduceat(sa, group)
    first = np.empty(total, np.int64)
    first[sa] = np.repeat(least, np.diff(np.append(group, total)))
    mine = first[at]
    later = np.flatnonzero(mine != at)
    lone = np.flatnonzero(mine == at)
    return (doc[later], pos[later], doc[window_of[mine[later]]]), (doc[lone], pos[lone], np.concatenate(keys)[lone], rank[at[lone]])


_NAMES = ["key", "shard", "id", "t", "pos", "n", "first", "ranks", "text"]


def _rows(kind) -> str:
    return f"key long, shard long, id {kind}, t long, pos int, n int, first {kind}, ranks binary, text string"


def _packed(late, lone, shard: int, ids: pa.Array, ts: pa.Array, text_of) -> pa.RecordBatch:
    """Rows of two kinds: repeats, (id, t, pos, n, first), and representatives, (key, shard, id, t, pos, n, ranks, text).

    ``late`` is (doc, pos, first doc), ``lone`` (doc, pos, key, rank), both by doc and pos; docs are places in ``ids`` and ``ts``.
    """
    start, n = _runs(*late)
    doc, pos, key, rank = lone
    rstart, rn = _runs(doc, pos, key.view(np.int64))
    at = np.append(rstart, len(doc)).astype(np.int64) * 4
    ranks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rstart), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(rank.astype(np.int32).tobytes())]).cast(pa.binary())
    z, m = len(start), len(rstart)
    take = pa.array(np.concatenate([late[0][start], doc[rstart]]))
    cols = [
        pa.concat_arrays([pa.nulls(z, pa.int64()), pa.array(key.view(np.int64)[rstart])]), pa.array(np.full(z + m, shard, np.int64)), ids.take(take), ts.take(take),
        pa.array(np.concatenate([late[1][start], pos[rstart]]).astype(np.int32)), pa.array(np.concatenate([n, rn]).astype(np.int32)),
        pa.concat_arrays([ids.take(pa.array(late[2][start])), pa.nulls(m, ids.type)]), pa.concat_arrays([pa.nulls(z, pa.binary()), ranks]),
        pa.concat_arrays([pa.nulls(z, pa.string()), pa.array([text_of(r, k) for r, k in zip(rstart, rn)], pa.string())]),
    ]
    return pa.RecordBatch.from_arrays(cols, _NAMES)


def _shards(docs: DataFrame, window: int, shard_words: int) -> DataFrame:
    """The rows of :func:`_packed` of each shard: documents as they come, until they have ``shard_words`` words."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, int, list[str], np.ndarray, np.ndarray]] = []
        names: dict[str, int] = {}
        count = number = 0

        def done(types) -> pa.RecordBatch:
            order = ranked(names)
            hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in names), np.uint64, len(names))
            held.sort(key=lambda x: x[:2])
            late, lone = shard_repeats([(order[w], hashed[w], places) for _, _, _, w, places in held], window)
            text_of = lambda r, n: " ".join(held[lone[0][r]][2][lone[1][r] : lone[1][r] + n + window - 1])
            shard = (TaskContext.get().partitionId() << 24) + number
            return _packed(late, lone, shard, pa.array([x[0] for x in held], types[0]), pa.array([x[1] for x in held], pa.int64()), text_of)

        before = None
        for batch in batches:
            types = [batch.schema.field("id").type]
            for key, t, text, places in zip(*(batch.column(c) for c in ("id", "t", "text", "places"))):
                key, t = key.as_py(), t.as_py()
                if before == (key, t):  # a repeated row
                    continue
                before = (key, t)
                if count >= shard_words:
                    yield done(types)
                    held, names, count, number = [], {}, 0, number + 1
                words = text.as_py().split()
                held.append((key, t, words, np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)), np.array(places.as_py(), np.int64)))
                count += len(words)
        if held:
            yield done(types)

    return docs.mapInArrow(run, _rows(kind))


# --- merging


def _compared(stream: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """-1, 0 or 1 as the window of words at ``a`` comes before, equals or comes after that at ``b``."""
    out = np.zeros(len(a), np.int8)
    open_ = np.arange(len(a))
    for at in range(0, window, 10):
        if not len(open_):
            break
        span = np.arange(at, min(at + 10, window))
        x, y = stream[a[open_, None] + span], stream[b[open_, None] + span]
        differ = x != y
        k = differ.argmax(axis=1)
        rows = np.arange(len(open_))
        decided = differ[rows, k]
        out[open_[decided]] = np.where(x[rows, k] < y[rows, k], -1, 1)[decided]
        open_ = open_[~decided]
    return out


def merged(key: np.ndarray, shard: np.ndarray, rank: np.ndarray, start: np.ndarray, stream: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each window, all windows by key and words): windows at ``start`` of ``stream`` with the same key and words are of one class.

    Within a key the windows of each shard are a sorted list: a stretch of its suffix array. Lists are merged two by two:
    each window of the one is looked up in the other by binary search, comparing words; it is found there, or its
    place among them is.
    """
    order = np.lexsort((rank, shard, key))
    parent = np.arange(len(key))
    if not len(key):
        return parent, order
    key, shard = key[order], shard[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])])
    lead = np.concatenate([[True], key[1:] != key[:-1]])
    number = np.cumsum(new) - 1
    lists = number - np.repeat(number[lead], np.diff(np.append(np.flatnonzero(lead), len(key))))  # 0, 1, … within each key
    while lists.any():
        begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lists[1:] != lists[:-1])]))
        stop = np.append(begin[1:], len(key))
        which = np.repeat(np.arange(len(begin)), stop - begin)
        right = np.flatnonzero(lists % 2 == 1)
        lo, hi = begin[which[right] - 1].copy(), stop[which[right] - 1].copy()
        end = hi.copy()
        live = np.arange(len(right))
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            less = _compared(stream, start[order[mid]], start[order[right[live]]], window) < 0
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        there = np.flatnonzero(lo < end)
        equal = there[_compared(stream, start[order[lo[there]]], start[order[right[there]]], window) == 0]
        parent[order[right[equal]]] = order[lo[equal]]
        # what was found goes; the rest stands before the window it was found to precede
        place, side = np.arange(len(key)), np.ones(len(key), np.int8)
        place[right], side[right] = lo, 0
        keep = np.ones(len(key), bool)
        keep[right[equal]] = False
        kept = np.flatnonzero(keep)
        # a lone left list keeps its own places; those of two lists lie in one range, which begins with the left one
        by = kept[np.lexsort((kept, side[kept], place[kept]))]
        order, key, lists = order[by], key[by], lists[by] // 2
    while not np.array_equal(parent, parent[parent]):
        parent = parent[parent]
    return parent, order


def _merge(parts: DataFrame, window: int, groups: int) -> DataFrame:
    """One round of merging: representatives of the same key, of shards of the same one of ``groups`` groups, to rows of :func:`_packed`.

    Repeats are final. In a round that isn't the last, representatives of each group go on as those of one shard.
    """
    group = F.pmod(F.xxhash64("shard"), F.lit(groups))
    routed = parts.select(F.xxhash64("key", group).alias("route"), "key", group.alias("group"), "shard", "id", "t", "pos", "n", "ranks", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, 20_000):
            n, place = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "pos"))
            words = " ".join(table.column("text").to_pylist()).split()
            names: dict[str, int] = {}
            flat = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
            stream = ranked(names)[flat].astype(np.int32)
            base = np.cumsum(n + window - 1) - (n + window - 1)
            row = np.repeat(np.arange(len(n)), n)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start, pos = base[row] + offset, place[row] + offset
            rank = np.frombuffer(b"".join(table.column("ranks").to_pylist()), np.int32)
            _, code = np.unique(np.stack([table.column("key").to_numpy(), table.column("group").to_numpy()]), axis=1, return_inverse=True)
            same, order = merged(code.ravel()[row], table.column("shard").to_numpy()[row], rank, start, stream, window)
            owners = list(zip(table.column("id").to_pylist(), table.column("t").to_pylist()))
            own = sorted(set(owners))
            at = {d: k for k, d in enumerate(own)}
            doc = np.fromiter((at[d] for d in owners), np.int64, len(owners))[row]
            # of each class the earliest window stays
            by = np.lexsort((pos, doc, same))
            lead = np.concatenate([[True], same[by][1:] != same[by][:-1]])
            holder = np.empty(len(by), np.int64)
            holder[by] = np.repeat(by[lead], np.diff(np.append(np.flatnonzero(lead), len(by))))
            late = np.flatnonzero(holder != np.arange(len(by)))
            late = late[np.lexsort((pos[late], doc[late]))]
            late = (doc[late], pos[late], doc[holder[late]])
            ids, ts = pa.array([d[0] for d in own], table.schema.field("id").type), pa.array([d[1] for d in own], pa.int64())
            none = np.zeros(0, np.int64)
            if groups == 1:
                yield _packed(late, (none, none, none.view(np.uint64), none), 0, ids, ts, None)
                continue
            depth = np.empty(len(by), np.int64)
            depth[order] = np.arange(len(order))
            lone = np.unique(holder)
            of = table.column("group").to_numpy()[row]
            for g in np.unique(of):
                some = lone[of[lone] == g]
                some = some[np.lexsort((pos[some], doc[some], row[some]))]
                text_of = lambda r, k, some=some: " ".join(words[start[some[r]] : start[some[r]] + k + window - 1])
                yield _packed(late, (doc[some], pos[some], table.column("key").to_numpy()[row[some]].view(np.uint64), depth[same[some]]), int(g), ids, ts, text_of)
                late = (none, none, none)

    return routed.repartition("route").sortWithinPartitions("route").mapInArrow(run, _rows(parts.schema["id"].dataType.simpleString()))


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, shard_words: int = 1_000_000, fan_in: int = 512) -> DataFrame:
    """(id, text_hash, start_word, end_word, duplicate_of): all passages of ``window`` words or more that stand earlier elsewhere.

    Earlier is a smaller id, or the same document farther in front. Words are what blanks separate. Every window of
    ``window`` words is held against all others; what is reported joins the windows that aren't the first of their kind. ``duplicate_of`` is a document
    that holds an earlier copy of the passage's first window. Without these spans every passage is left once.

    1. Each window has an anchor, its least run of 16 words by hash. Anchors whose key occurs once are in no repeat.
    2. The words around the others are gathered by document into shards, and each shard has its suffix array and
       common prefixes: they give the repeats within the shard, and one representative of each window.
    3. Representatives come together by their anchors, ``fan_in`` shards at a time, and sorted lists of the shards are
       merged by binary search, comparing words. What a round leaves is merged again until one group is left, so that
       a passage of all shards is never in one task with all of them.

    Null ids, null texts and texts shorter than ``window`` words have no passages. Repeated rows of one id and text are
    one document; different texts of one id are documents of their own, told apart by ``text_hash``.
    """
    text = column(text_col)
    rows = docs.select(column(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text")).where("id is not null and text is not null")
    shared = _shared(_anchor_rows(rows, window)).groupBy("id", "t").agg(F.sort_array(F.collect_set("pos")).alias("places"))
    asked = rows.join(shared, ["id", "t"]).select("id", "t", "text", "places").repartition("id", "t").sortWithinPartitions("id", "t")
    parts = written(_shards(asked, window, shard_words), "shards")
    near = parts.where("key is null").select("id", "t", "pos", "n", "first")
    groups = parts.where("key is not null").select("shard").distinct().count()
    left = parts
    while True:
        groups = max(1, -(-groups // fan_in))
        left = _merge(left.where("key is not null"), window, groups)
        if groups > 1:
            left = written(left, "merged")
        near = near.union(left.where("key is null").select("id", "t", "pos", "n", "first"))
        if groups == 1:
            break
    spans = near.select("id", "t", F.col("pos").alias("a"), (F.col("pos") + F.col("n") - 1 + window).alias("b"), "first")
    up = Window.partitionBy("id", "t").orderBy("a", "b")
    reach = F.max("b").over(up.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(reach >= F.col("a"), 0).otherwise(1))
    spans = spans.withColumn("island", F.sum("new").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    out = spans.groupBy("id", "t", "island").agg(F.min("a").alias("start_word"), F.max("b").alias("end_word"), F.min_by("first", F.struct("a", "first")).alias("duplicate_of"))
    return out.select(F.col("id").alias(id_col), F.col("t").alias("text_hash"), "start_word", "end_word", "duplicate_of")
