"""Words of texts as hashes, block by block, for shingles and seeds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import slices

BLOCK_CHARS = 800_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def split(texts: pa.Array) -> pa.ListArray:
    """Words of each text (none of a null): lower case, cut at white space."""
    return pc.utf8_split_whitespace(pc.utf8_lower(pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.string()), ""))))


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts on end, text i has [ends[i]:ends[i + 1]])."""
    words = split(texts)
    lens = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().dictionary_encode()
    table = np.fromiter((xxhash.xxh64_intdigest(w or "") for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    # a text of white space alone splits into one empty word
    hashes = table[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.uint64)
    blank = (lens == 1) & (pc.utf8_length(pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.string()), ""))).to_numpy(zero_copy_only=False) == 0)
    if blank.any():
        starts = np.cumsum(lens) - lens
        keep = np.ones(len(hashes), bool)
        keep[starts[blank]] = False
        hashes, lens = hashes[keep], np.where(blank, 0, lens)
    return hashes, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row (they may cross texts); len - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x100000001B3) + mix(hashes[j : j + n] + np.uint64(j))
        return mix(out)


def blocks(batch: pa.RecordBatch, column: str = "text"):
    """(rows of a batch, their hashes, ends) for stretches of about ``BLOCK_CHARS`` characters."""
    texts = batch.column(column)
    for a, b in slices(pc.fill_null(pc.utf8_length(texts.cast(pa.string())), 0).to_pylist(), BLOCK_CHARS):
        yield batch.slice(a, b - a), *hashed(texts.slice(a, b - a))


def owners(ends: np.ndarray) -> np.ndarray:
    """Index of the text of every word."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def rolling_rows(parts: np.ndarray) -> np.ndarray:
    """One hash for the last axis of ``parts``."""
    out = np.zeros(parts.shape[:-1], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(parts.shape[-1]):
            out = mix(out * np.uint64(0x100000001B3) + parts[..., j] + np.uint64(j + 1))
    return out


def split_as_written(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the words of one text, in characters: the words that ``split`` counts."""
    at, out = 0, []
    for word in pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pa.array([text]))).to_pylist()[0]:
        if word:
            at = text.index(word, at)
            out.append((at, at + len(word)))
            at += len(word)
    return out
