"""Vectorised kernels over the UTF-8 buffers of Arrow string columns.

Every kernel works on one slice of a batch (`slices`), so memory follows
`SLICE_BYTES` and the longest single text, never the size of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Arrow's own pools keep what was freed; a worker that is used again shall not.
pa.set_memory_pool(pa.system_memory_pool())
SLICE_BYTES = 1_000_000

#: `[^\x20\x09-\x0D]`: every byte but ASCII white space.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` of lower-cased text: digits, a-z and everything beyond ASCII.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: So many powers at most stay in a worker; a longer text makes its own and lets them go.
KEPT_POWERS = 1 << 20
#: Strings from this many bytes on get an XXH3 hash instead: modulo 2**64, a polynomial of any odd base is equal for
#: certain pairs of long strings (Thue-Morse strings of 1,024 symbols).
LONG_BYTES = 64


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size, out = max(n, 1 << 16), []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.ones(1, dtype=U64)
            while len(table) < size:
                table = np.concatenate([table, table * U64(pow(b, len(table), 1 << 64))])
            out.append(table[:size].copy())
        have = (out[0], out[1])
        if size <= KEPT_POWERS:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[k] * base**k modulo 2**64, with a leading zero."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(len(values) + 1, base)[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Place-independent hashes of values[starts:ends]."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), base)[1][starts])


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix(_BYTE_VALUE[data], _BASE)


def byte_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(sums, starts, ends, _BASE)


def string_hash(data: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of the strings data[starts:ends], without the polynomial's equal pairs. sums: byte_sums(data)."""
    out = byte_hash(sums, starts, ends)
    long = np.flatnonzero(ends - starts >= LONG_BYTES)
    if len(long):
        body = np.ascontiguousarray(data).data
        out[long] = [xxhash.xxh3_64_intdigest(body[i:j]) for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def word_window_hash(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of `length` (a few tens at most) consecutive words from each word index in starts."""
    sums = prefix(hashes, _WORD_BASE)
    return span_hash(sums, starts, starts + length, _WORD_BASE)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 byte offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive pieces of about `limit` text bytes; a longer text is a piece of its own."""
    _, at = buffers(batch.column(batch.schema.get_field_index(column)))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 word offsets of the texts. No word crosses texts."""
    mask = table[data]
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(at), dtype=np.int64)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = np.concatenate([[False], mask[:-1]]) & ~edge[:-1]
    after = np.concatenate([mask[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def owner(offsets: np.ndarray) -> np.ndarray:
    """The text of each item, from item offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values by text."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def window_starts(offsets: np.ndarray, length: int) -> np.ndarray:
    """Item indices at which `length` consecutive items of one text begin."""
    n = int(offsets[-1])
    last = np.repeat(offsets[1:], np.diff(offsets)) - length
    return np.flatnonzero(np.arange(n) <= last)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
