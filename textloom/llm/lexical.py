"""Array-at-a-time text primitives shared by the corpus operators.

A batch of texts becomes one array of code points; words, their hashes and
their n-grams are then found by array arithmetic, so the cost is a few
nanoseconds a character and no Python object is made per word.

A *word* is a maximal run of ASCII letters, digits and code points above
U+007F in the lower-cased text, i.e. a match of ``[a-z0-9\\x80-\\U0010FFFF]+``.
Null texts count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters handled at a time; bounds the memory of a Python worker.
CHUNK_CHARS = 400_000

_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, cached."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(p)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end], equal for equal contents."""
    n = len(codes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_B_INV, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(_B, n + 1)[starts])


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Words:
    """The words of some texts: where each begins and ends in codes, and the index of its text."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    #: first[i]:first[i + 1] are the words of text i.
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(self.codes, self.starts, self.ends)


#: Texts as a list, or as an Arrow array, of which only the slice at hand becomes Python strings.
Texts = list[str | None] | pa.Array


def code_points(texts: Texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points with a line end after each, and where each text begins (and the end)."""
    own = [(t.lower() if lower else t) if t else "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
    bounds = np.zeros(len(own) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in own], out=bounds[1:])
    joined = "\n".join(own) + "\n"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    padded = np.zeros(len(inside) + 2, np.int8)
    padded[1:-1] = inside
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    return edge[::2], edge[1::2]


def words(texts: Texts, lower: bool = True) -> Words:
    codes, bounds = code_points(texts, lower)
    starts, ends = runs(_WORD[np.minimum(codes, 255)])
    return Words(codes, starts, ends, *owners(starts, bounds))


_KIND = np.zeros(256, np.int8)
_KIND[33:127] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def tokens(texts: Texts) -> Words:
    """Words with their case kept, and runs of ASCII punctuation: the matches of
    ``[A-Za-z0-9\\x80-\\U0010FFFF]+|[!-/:-@\\[-`{-~]+``."""
    codes, bounds = code_points(texts, lower=False)
    kind = _KIND[np.minimum(codes, 255)]
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    inside = kind[edge[:-1]] > 0 if len(edge) else np.zeros(0, bool)
    starts, ends = edge[:-1][inside], edge[1:][inside]
    return Words(codes, starts, ends, *owners(starts, bounds))


def owners(starts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start the index of its text, and for each text the index of its first start."""
    first = np.searchsorted(starts, bounds)
    return np.repeat(np.arange(len(bounds) - 1), np.diff(first)), first


def chunks(texts: Texts, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most characters; a longer text has a range of its own."""
    begin = size = 0
    lengths = pc.utf8_length(texts).fill_null(0).to_pylist() if isinstance(texts, pa.Array) else [len(t or "") for t in texts]
    for i, n in enumerate(lengths):
        n += 1
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive words of one text, and their texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    h = hashes[:m]
    for k in range(1, n):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + m])
    same = doc[:m] == doc[n - 1 :]
    return (h[same], doc[:m][same]) if n > 1 else (h, doc)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start .. start+size-1 of every range, one after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = sizes > 0
    starts, sizes = starts[keep].astype(np.int64), sizes[keep].astype(np.int64)
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(sizes)[:-1]
    step[at] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(step)


def sums_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values first[i]:first[i+1]; 0 for an empty range."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
