"""Quality classifier: supervised subword embeddings averaged per document, with a softmax over classes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK, column, columns, drop_written, fresh, mixed, written

CLASSES = ("clean", "low", "toxic")
#: words of no score added to each average, so that a single word decides little
PAD = 8
BUCKETS = 1 << 18
#: what a pair of words weighs beside a word, about as much as each of a word's own features
PAIR = 0.02
#: the bucket of all pairs of equal words, whatever the word; such a pair weighs as much as a word
EQUAL = 1


def features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word): for each word its own bucket and those of its runs of 3 to 6 characters, its ends marked."""
    own = (hashes(words) % np.uint64(buckets)).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))
    found, of = [own], [np.arange(len(words))]
    h = mixed(codes + np.uint64(1))
    with np.errstate(over="ignore"):
        for n in range(2, 7):
            h = mixed(h[: len(codes) - n + 1] * np.uint64(31) + codes[n - 1 :])
            if n > 2:
                whole = np.flatnonzero(left[: len(h)] >= n)
                found.append((h[whole] % np.uint64(buckets)).astype(np.int64))
                of.append(word[whole])
    return np.concatenate(found), np.concatenate(of)


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def pairs(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each two words that follow each other, from the hashes of all words."""
    with np.errstate(over="ignore"):
        return (mixed(h[:-1] * np.uint64(31) + h[1:]) % np.uint64(buckets)).astype(np.int64)


def repeats(h: np.ndarray) -> int:
    """How many words equal the one before them."""
    return int((h[1:] == h[:-1]).sum())


def vector(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of a text: the mean of its words and pairs of words; a word is the mean of its features."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    total = np.zeros(buckets, np.float64)
    names, at = np.unique(np.array(words, object), return_inverse=True)
    names = names.tolist()
    many = np.bincount(at, minlength=len(names))
    for k in range(0, len(names), 10_000):
        f, word = features(names[k : k + 10_000], buckets)
        size = np.bincount(word, minlength=min(10_000, len(names) - k))
        total += np.bincount(f, (many[k : k + 10_000] / size)[word], buckets)
    h = hashes(names)[at]
    total += PAIR * np.bincount(pairs(h, buckets), minlength=buckets)
    total[EQUAL] += repeats(h)
    f = np.flatnonzero(total)
    return f.astype(np.int32), (total[f] / (n + PAD)).astype(np.float32)


def packed(f: np.ndarray, w: np.ndarray, buckets: int = BUCKETS) -> bytes:
    """A vector in 4 bytes a feature: how many features each 2¹⁶ of the buckets have, the largest weight, the rest of the features, weights as halves."""
    largest = np.float32(w.max() if len(w) else 1)
    return np.bincount(f >> 16, minlength=-(-buckets >> 16)).astype(np.int32).tobytes() + largest.tobytes() + f.astype(np.uint16).tobytes() + (w / largest).astype(np.float16).tobytes()


class Packed(Sequence):
    """Vectors as :func:`packed` made them, unpacked when asked for."""

    def __init__(self, rows: pa.ChunkedArray, buckets: int = BUCKETS):
        self.rows, self.parts = rows.combine_chunks(), -(-buckets >> 16)

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        data = self.rows[k].as_buffer()
        many, head = np.frombuffer(data, np.int32, self.parts), 4 * self.parts + 4
        n = int(many.sum())
        f = np.frombuffer(data, np.uint16, n, head).astype(np.int32) + (np.repeat(np.arange(self.parts, dtype=np.int32), many) << 16)
        return f, np.frombuffer(data, np.float16, n, head + 2 * n).astype(np.float32) * np.frombuffer(data, np.float32, 1, head - 4)


@dataclass
class Model:
    """``scores[f]`` is what feature f adds to each class's logit: its vector times the output layer."""

    scores: np.ndarray
    bias: np.ndarray

    def of(self, words: list[str]) -> np.ndarray:
        """The mean of each word's features' scores."""
        f, word = features(words, len(self.scores))
        n = np.bincount(word, minlength=len(words))
        return np.stack([np.bincount(word, self.scores[f, k], len(words)) for k in range(len(CLASSES))], axis=1) / n[:, None]


def train(vectors: Sequence[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, *, dim: int = 10, buckets: int = BUCKETS, least_docs: int = 5, epochs: int = 10, batch: int = 32, rate: float = 1.5, seed: int = 0) -> Model:
    """Stochastic gradient descent on the cross-entropy, with Adagrad steps; the same vectors give the same model.

    Features of fewer than ``least_docs`` documents count as 0.
    """
    docs_with = np.zeros(buckets, np.int32)
    for f, _ in vectors:
        docs_with[f] += 1
    common = docs_with >= least_docs
    some = np.flatnonzero([common[f].any() for f, _ in vectors])
    rng = np.random.default_rng(seed)
    E = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    W = rng.uniform(-1 / dim, 1 / dim, (dim, len(CLASSES))).astype(np.float32)
    b = np.zeros(len(CLASSES), np.float32)
    gE, gW, gb = np.full(buckets, 1e-10, np.float32), np.full_like(W, 1e-6), np.full_like(b, 1e-6)
    target = np.eye(len(CLASSES), dtype=np.float32)[classes]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(some)
        for at in range(0, len(some), batch):
            rows = some[at : at + batch]
            parts = [(f[common[f]], w[common[f]]) for f, w in (vectors[k] for k in rows)]
            size = np.array([len(f) for f, _ in parts])
            f, v = (np.concatenate(x) for x in zip(*parts))
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            h = np.add.reduceat(E[f] * v[:, None], start, axis=0)
            z = h @ W + b
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True) - target[rows]
            dW, db, dh = h.T @ d, d.sum(axis=0), d @ W.T
            order = np.argsort(f, kind="stable")
            fs = f[order]
            first = np.flatnonzero(np.concatenate([[True], fs[1:] != fs[:-1]]))
            doc = np.repeat(np.arange(len(rows)), size)[order]
            g = np.add.reduceat(dh[doc] * v[order][:, None], first, axis=0)
            u = fs[first]
            gE[u] += (g * g).mean(axis=1)
            E[u] -= step * g / np.sqrt(gE[u])[:, None]
            gW += dW * dW
            gb += db * db
            W -= step * dW / np.sqrt(gW)
            b -= step * db / np.sqrt(gb)
    return Model(np.where(common[:, None], E @ W, 0).astype(np.float32), b)


def probabilities(model: Model, batches: Iterator[list[str | None]], limit: int = 300_000) -> Iterator[np.ndarray]:
    """Class probabilities for each text; NaN for texts that are null or have no words."""
    at: dict[str, int] = {}
    table, known = np.empty((4096, len(CLASSES)), np.float64), np.empty(4096, np.uint64)
    for texts in batches:
        out = np.full((len(texts), len(CLASSES)), np.nan)
        for k, text in enumerate(texts):
            words = text.split() if text else []
            if not words:
                continue
            total = np.zeros(len(CLASSES))
            for a in range(0, len(words), 100_000):
                part = words[max(0, a - 1) : a + 100_000]  # one word of the part before, for the pair with it
                new = set(part).difference(at)
                if new:
                    if len(at) + len(new) > limit:
                        at.clear()
                        new = set(part)
                    while len(at) + len(new) > len(table):
                        table, known = np.concatenate([table, np.empty_like(table)]), np.concatenate([known, np.empty_like(known)])
                    new = sorted(new)
                    rows = slice(len(at), len(at) + len(new))
                    table[rows], known[rows] = model.of(new), hashes(new)
                    at.update(zip(new, range(rows.start, rows.stop)))
                which = np.fromiter(map(at.__getitem__, part), np.int64, len(part))
                total += table[which[min(a, 1) :]].sum(axis=0) + repeats(known[which]) * model.scores[EQUAL].astype(np.float64)
                total += PAIR * model.scores[pairs(known[which], len(model.scores))].sum(axis=0, dtype=np.float64)
            out[k] = total / (len(words) + PAD) + model.bias
        z = np.exp(out - out.max(axis=1, keepdims=True))
        yield z / z.sum(axis=1, keepdims=True)


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", train_rows: int = 4000, train_chars: int = 32_000_000) -> Model | None:
    """A model from ``labels`` (id, quality, toxic). None if there is nothing to tell apart.

    It is fitted on at most ``train_rows`` labelled documents, those whose ids hash lowest, of ``train_chars``
    characters together at most: one that would go beyond is passed over. Whole texts become vectors in tasks; the
    driver sees only these. Rows whose text or label is null teach nothing; of several labels or texts of one
    document one is used. Toxic wins over low.
    """
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    marks = labels.select(column(label_id_col).alias("id"), kind.alias("kind")).where("id is not null and kind is not null").groupBy("id").agg(F.max("kind").alias("kind"))
    texts = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).where("id is not null and text is not null")
    # labels are ranked first, so that texts are joined with few rows; those without a document are passed over
    present = texts.groupBy("id").agg(F.max(F.length("text")).alias("chars")).join(marks, "id")
    chosen, chars = [], 0
    for r in present.orderBy(F.xxhash64("id"), "id").limit(train_rows).collect():
        if chars + r["chars"] <= train_chars:
            chars += r["chars"]
            chosen.append((r["id"], r["kind"]))
    if len({c for _, c in chosen}) < 2:
        return None
    few = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("kind", T.IntegerType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                features = packed(*vector(batch.column(2)[k].as_py()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([features])], ["id", "kind", "features"])

    kind_ = docs.schema[id_col].dataType.simpleString()
    rows = texts.join(F.broadcast(few), "id").groupBy("id", "kind").agg(F.min("text").alias("text"))
    rows = rows.mapInArrow(run, f"id {kind_}, kind int, features binary")
    # what is sorted is written first, or vectors would be made twice, for the splitters and for the rows
    held = written(rows, "vectors")
    rows = held.orderBy("id").select("kind", "features").toArrow()
    drop_written(held)
    return train(Packed(rows.column("features")), rows.column("kind").to_numpy().astype(np.int64))


def classify(docs: DataFrame, model: Model | None, *, text_col: str = "text", score_col: str = "p_clean", toxic_col: str = "p_toxic") -> DataFrame:
    """``docs`` with the probabilities of being clean and of being toxic; null where there are no words or no model.

    Columns of these names are replaced.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in (score_col.lower(), toxic_col.lower())))
    if model is None:
        return docs.withColumns({score_col: F.lit(None).cast("double"), toxic_col: F.lit(None).cast("double")})
    where = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(toxic_col, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def texts():
            for batch in batches:
                kept.append(batch)
                yield batch.column(where).to_pylist()

        for p in probabilities(model, texts()):
            batch = kept.pop()
            more = [pa.array(p[:, k], pa.float64(), from_pandas=True) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, score_col, toxic_col])

    return docs.mapInArrow(score, schema)


def quality_filter(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, **fit) -> DataFrame:
    """``docs`` that the classifier takes for clean with a probability of ``least`` or more; their columns as they are.

    Documents without words are rejected: null, empty or blank texts. With no labels, or labels of one class only,
    there is no model and every other document stays. Repeated rows are judged alike. Every row is scored on its
    whole text where it is read: one scan, no shuffle.
    """
    model = fitted(docs, labels, id_col=id_col, text_col=text_col, **fit)
    if model is None:
        return docs.where(column(text_col).rlike("[^" + BLANK[1:]))
    p, q = fresh(docs, "_p_clean"), fresh(docs, "_p_toxic")
    return classify(docs, model, text_col=text_col, score_col=p, toxic_col=q).where(column(p) >= least).select(*columns(docs.columns))
