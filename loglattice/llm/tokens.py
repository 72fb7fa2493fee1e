"""Token counts, with long documents encoded in overlapping chunks that are resynchronised."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import column

#: the vocabulary's file; any file of base64 tokens and ranks will do
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: what splits a text before the merges, for this family of vocabularies
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK, OVERLAP = 16384, 256


@lru_cache(2)
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding, and the number of bytes of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def _start(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a character begins."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def proven(data: bytes, at: int) -> bool:
    """Whether every encoding of the text breaks here, whatever stands farther to the left or right.

    No piece of the pattern goes on from a character that isn't blank to a blank, or from a letter to one of these
    marks; the pieces on both sides, and so their merges, are then independent of each other.
    """
    if not 0 < at < len(data) or data[at] not in b" \n\t\r.,;:!?":
        return False
    a = at - 1
    while data[a] & 0xC0 == 0x80:
        a -= 1
    before = data[a:at].decode("utf-8", "replace")
    return before.isalpha() if data[at] in b".,;:!?" else before.isprintable() and not before.isspace()


#: a run of these as long as LONG_RUN is a piece of its own, but for its last character where more follows
_RUNS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def _parts(text: str) -> Iterator[tuple[bool, str]]:
    """(whether it is one piece, part): the text cut at long runs of blanks, where every encoding of it breaks.

    The pattern takes such a run as one piece, without its last character if the text goes on; and its search for the
    end of the run goes as deep as the run is long.
    """
    at = 0
    for m in _RUNS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() > at:
            yield False, text[at : m.start()]
        yield True, text[m.start() : end]
        at = end
    if at < len(text):
        yield False, text[at:]


def encoded(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """The tokens of the text, in arrays one after the other: exactly those it has when it is encoded in one go.

    Each chunk begins ``overlap`` bytes before the last one ended. Both have token boundaries there; at the last one
    common to both that is :func:`proven`, the tokens of the earlier chunk end and those of the later one begin. If
    there is none, the overlap is doubled, back to where the earlier chunk's tokens began; then the chunk is doubled.
    """
    enc, size = encoder(path)
    for whole, part in _parts(text):
        if whole:
            yield np.array(enc._core_bpe.encode_single_piece(part.encode()), np.int64)
        elif len(part) * 4 <= chunk or len(data := part.encode()) <= chunk:
            yield np.array(enc.encode_ordinary(part), np.int64)
        else:
            yield from _spliced(data, enc, size, chunk, overlap)


def _spliced(data: bytes, enc: tiktoken.Encoding, size: np.ndarray, chunk: int, overlap: int) -> Iterator[np.ndarray]:
    def tokens(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of these bytes, and their boundaries, the first one being ``a``."""
        t = np.array(enc.encode_ordinary(data[a:b].decode("utf-8")), np.int64)
        return t, a + np.concatenate([[0], np.cumsum(size[t])])

    base, end = 0, _start(data, chunk)
    held, bounds = tokens(base, end)  # right from ``base`` up to any proven boundary
    while end < len(data):
        wide, length = overlap, chunk
        while True:
            start = _start(data, max(base, end - wide))
            stop = _start(data, start + max(length, 2 * wide))
            fresh, marks = tokens(start, stop)
            common = np.intersect1d(bounds, marks, assume_unique=True)
            common = common[(common > start) & (common < end) & (common > base)]
            cut = next((int(p) for p in common[::-1] if proven(data, int(p))), None)
            if cut is not None:
                yield held[: int(np.searchsorted(bounds, cut))]
                k = int(np.searchsorted(marks, cut))
                base, held, bounds, end = cut, fresh[k:], marks[k:], stop
                break
            if start == base:  # the whole of the earlier chunk again, and as much more
                held, bounds, end = fresh, marks, stop
                break
            wide *= 2
            length = max(length, 2 * wide)
    yield held


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, tokens, chunks) of every row, in one scan without a shuffle; ``chunks`` says in how many parts it was spliced.

    A null text has null tokens and no chunks, an empty one no tokens. Runs of blanks of any length are counted.
    Repeated rows are counted each, and null ids are reported as they are.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, chunks = [], []
            for text in batch.column(1):
                text = text.as_py()
                parts = None if text is None else [len(t) for t in encoded(text, vocabulary, chunk, overlap)]
                tokens.append(None if parts is None else sum(parts))
                chunks.append(len(parts or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(chunks, pa.int32())], ["id", "tokens", "chunks"])

    return docs.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(run, f"id {kind}, tokens long, chunks int").withColumnRenamed("id", id_col)
