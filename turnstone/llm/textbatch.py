"""Texts of an Arrow batch as one flat array of bytes: tokens, hashes and sums by document without a Python loop a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]

#: Bytes of text that are looked at together; a longer document comes alone, whole.
SLICE_BYTES = 1 << 19

#: Documents that are looked at together, as distinct() has 16 bits for them.
MOST_ROWS = 1 << 16

SPACE, WORD = 0, 1
#: Letters, digits and all bytes of non-ASCII characters make words, white space parts; a run of one other byte is a token.
CLASSES = np.array([WORD if b >= 128 or chr(b).isalnum() else SPACE if chr(b).isspace() or b == 0 else 2 + b for b in range(256)], np.int16)
#: Words alone: everything else parts them.
WORDS_ONLY = np.where(CLASSES == WORD, WORD, SPACE).astype(np.int16)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each document starts, with the end at last. A null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)), at - at[0]


def slices(batches, column: str = "text", lower: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, starts) of at most SLICE_BYTES and MOST_ROWS, or of one document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, lo = np.cumsum(sizes), 0
        while lo < batch.num_rows:
            hi = min(lo + MOST_ROWS, max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES, "right"))))
            part = batch.slice(lo, hi - lo)
            texts = part.column(k)
            yield (part, *flat(pc.utf8_lower(texts) if lower else texts))
            lo = hi


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                grown = np.full(n, base, U64)
                grown[0] = 1
                _powers[k] = np.cumprod(grown, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish of 64 bits (of the splitmix family)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal spans wherever they lie."""
    if not len(starts):
        return np.empty(0, U64)
    power, inverse = _pow(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def tokens(data: np.ndarray, at: np.ndarray, classes: np.ndarray = CLASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the tokens, in order."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    kind = classes[data]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[at[:-1][at[:-1] < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    held = kind[starts] != SPACE
    starts, ends = starts[held], ends[held]
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of `width` words; a document of fewer words, but one at least, is one shingle."""
    starts, ends, doc = tokens(data, at, WORDS_ONLY)
    words = span_hashes(data, starts, ends)
    docs = len(at) - 1
    count = np.bincount(doc, minlength=docs)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < width))
    n = len(words) - width + 1
    if n > 0:
        held = doc[: n] == doc[width - 1 :]
        s = np.zeros(n, U64)
        for k in range(width):
            s = s * U64(0x9FB21C651E98DF25) + words[k : k + n]
        s, d = mix(s)[held], doc[:n][held]
    else:
        s, d = np.empty(0, U64), np.empty(0, np.int64)
    if len(short):
        extra = np.zeros(len(short), U64)
        for k in range(width - 1):
            there = count[short] > k
            extra = np.where(there, extra * U64(0xA0761D6478BD642F) + words[np.minimum(first[short] + k, len(words) - 1)], extra)
        s, d = np.concatenate([s, mix(extra + count[short].astype(U64))]), np.concatenate([d, short])
        order = np.argsort(d, kind="stable")
        s, d = s[order], d[order]
    return s, d


def distinct(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each document's different hashes, in order; of a hash its upper 48 bits, and at most 2^16 documents.

    One sort of plain integers, many times as fast as a sort by two keys.
    """
    both = (doc.astype(U64) << U64(48)) | (hashes >> U64(16))
    both.sort()
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return both & U64((1 << 48) - 1), (both >> U64(48)).astype(np.int64)


def reduce_by_doc(ufunc: np.ufunc, values: np.ndarray, doc: np.ndarray, docs: int, empty) -> np.ndarray:
    """ufunc over each document's values, which lie together; `empty` for a document that has none."""
    out = np.full((docs, *values.shape[1:]), empty, values.dtype)
    if len(doc):
        heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[heads]] = ufunc.reduceat(values, heads, axis=0)
    return out
