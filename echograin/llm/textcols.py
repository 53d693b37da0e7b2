"""Vectorised word views over Arrow string columns.

The text operators that have to run Python work on the UTF-8 bytes of a whole
Arrow column with numpy instead of on Python strings.  A column is walked in
chunks of about ``CHUNK_BYTES`` so that the working arrays stay small whatever
the batch size is; one text is never split over two chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
#: Words over this many bytes are hashed one by one.
LONG_WORD = 1024
#: ASCII white space: space and 0x09 to 0x0D, the complement of the word class.
SPACE_BYTES = b" \t\n\x0b\x0c\r"

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, a bijection on 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


#: An odd multiplier; windows are hashed with its powers and its inverse's.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_POWERS = _powers(_BASE, LONG_WORD + 1)
#: Independent random keys, one for each position of a byte in its word: no pattern of a word cancels out as it does
#: with powers.  Words are told apart by FIRST; SECOND is there to check, from the bytes again.
FIRST, SECOND = (mix64(np.arange(1, LONG_WORD + 2, dtype=np.uint64) * _U(0xD6E8FEB86659FD93) + mix64(_U(k))) | _U(1) for k in (101, 202))
_grown: dict[int, np.ndarray] = {}


def _cached_powers(base: int, n: int) -> np.ndarray:
    have = _grown.get(base)
    if have is None or len(have) < n:
        have = _grown[base] = _powers(base, max(n, 1 << 16))
    return have[:n]


def byte_table(separators: bytes, fold_case: bool = False, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(is separator, hash value) of each byte; folding maps A-Z onto a-z."""
    with np.errstate(over="ignore"):
        values = mix64((np.arange(256, dtype=np.uint64) + _U(1)) * _U(0xD1342543DE82EF95) + _U(seed)) | _U(1)
    if fold_case:
        values[65:91] = values[97:123]
    sep = np.zeros(256, bool)
    sep[list(separators)] = True
    values[sep] = 0
    return sep, values


def column_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a string column; a null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row pointer) of the runs where mask holds, cut at row limits."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inner = offsets[(offsets > 0) & (offsets < n)]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    first[inner] = mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[inner - 1] = mask[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, keys: np.ndarray = _BYTE_POWERS) -> np.ndarray:
    """A 64-bit hash of each span.  Spans have to be in order and apart; what
    lies between them has to have the value 0 or to touch no span.  The default keys, powers of one base, are for
    features only: long words of two letters can be made to collide with them."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    with np.errstate(over="ignore"):
        # position of each byte in its span, for the bytes from the first start on
        begin = int(starts[0])
        reach = np.diff(np.append(starts, int(ends[-1])))
        at = np.arange(int(ends[-1]) - begin, dtype=np.int32) - np.repeat((starts - begin).astype(np.int32), reach)
        np.minimum(at, LONG_WORD, out=at)
        v = values[data[begin : int(ends[-1])]]
        v *= keys[at]
        h = np.add.reduceat(v, starts - begin)
        h = mix64(h + lengths.astype(np.uint64) * _U(_BASE))
    for i in np.flatnonzero(lengths > LONG_WORD):
        word = values[data[starts[i] : ends[i]]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"" if keys is _BYTE_POWERS else keys[:2].tobytes()).digest(), "little")
    return h


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, fold: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each distinct word, which of them each span is).  Spans are sorted by their hashes and then
    compared byte by byte with the one that stands for them; ``fold`` maps bytes that count as equal."""
    _, at, back = np.unique(hash_spans(data, starts, ends, values, FIRST), return_index=True, return_inverse=True)
    if not len(at):
        return at, back
    if fold is not None:
        data = np.frombuffer(fold, np.uint8)[data]
    like = at[back]
    lengths = ends - starts
    same = np.array_equal(lengths, lengths[like])
    if same:
        reach = np.repeat((starts[like] - starts).astype(np.int32), lengths)
        here = np.arange(len(reach), dtype=np.int32) + np.repeat((starts - np.cumsum(lengths) + lengths).astype(np.int32), lengths)
        same = bool((data[here] == data[here + reach]).all())
    if not same:  # two words of one hash
        raw, number, at = data.tobytes(), {}, []
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            k = number.setdefault(raw[a:b], len(number))
            if k == len(at):
                at.append(i)
            back[i] = k
        at = np.array(at)
    return at, back


def window_hashes(words: np.ndarray, pointer: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of ``size`` words inside a row; pointer: rows' first words."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * _cached_powers(_BASE, n), out=total[1:])
        h = (total[size:] - total[:-size]) * _cached_powers(_INVERSE, n)[: n - size + 1]
    row_end = np.repeat(pointer[1:], np.diff(pointer))
    at = np.flatnonzero(np.arange(n - size + 1) + size <= row_end[: n - size + 1])
    return mix64(h[at]), at


def crc_string(values: np.ndarray) -> np.ndarray:
    """crc32 of each integer written as text."""
    from zlib import crc32

    return np.fromiter((crc32(str(int(x)).encode()) for x in values), np.int64, len(values))
