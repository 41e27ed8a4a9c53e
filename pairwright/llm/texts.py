"""Arrow batches of texts as flat byte arrays: words, word hashes and columns computed from texts.

A batch is cut into chunks of whole texts, at most ``CHUNK_BYTES`` together unless one text alone is longer, so that memory
follows the longest text and not the table. Hashes are 64-bit polynomials over random byte values, taken from running sums; every
use of them treats equal hashes as equal words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch at most; the operators lower the session's setting to this.
BATCH_ROWS = 2000
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

#: Bytes of words: digits, letters and every byte of a character outside ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


with np.errstate(over="ignore"):
    BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[0x41:0x5B] = BYTE_VALUE[0x61:0x7B]

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table))
    return _powers[0], _powers[1]


def byte_sums(buf: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """Running sums from which the hash of every span follows."""
    power, _ = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    terms = values[buf]
    terms *= power[: len(buf)]
    np.cumsum(terms, out=sums[1:])
    return sums


def hashes_from(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per span of bytes."""
    _, inverse = _power_tables(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    return hashes_from(byte_sums(buf, values), starts, ends)


def per_text(marked: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    sums = np.zeros(len(marked) + 1, np.int64)
    np.cumsum(marked, out=sums[1:])
    return np.diff(sums[offs])


def spans_of(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all runs of marked bytes inside a text, and where each text's runs begin in that list."""
    if not len(member):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    edge = np.diff(member.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offs[1:-1]
    inner = cuts[(cuts > 0) & (cuts < len(member))]
    inner = np.unique(inner[member[inner] & member[inner - 1]]) if len(inner) else inner
    if len(inner):  # two texts meet inside what looks like one word
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends, np.searchsorted(starts, offs)


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each text's words begin in that list (one more entry than texts)."""
    return spans_of(IS_WORD[buf], offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with A-Z in lower case, and where each text's words begin."""
    starts, ends, first = word_spans(buf, offs)
    return span_hashes(buf, starts, ends, LOWER_VALUE), first


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on; the last ``width - 1`` positions have none."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(out)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` of runs of whole texts; a null text is empty."""
    column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, flat[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small: with Spark's 10,000 rows, buffers on both sides would hold tens of MB each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


Compute = Callable[[np.ndarray, np.ndarray], Sequence[pa.Array | np.ndarray]]


def map_texts(df: DataFrame, text: str, make: Callable[[], Compute], fields: StructType, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` with columns computed from ``text`` behind them, row by row and without a shuffle.

    ``make`` runs once per task and returns a function of ``(bytes, offsets)`` of some whole texts that gives
    one array per field. A kept column whose name is also a field is replaced.
    """
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    small_batches(df.sparkSession)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text__"))
    schema = StructType([f for f in source.schema if f.name != "__text__"] + list(fields))
    types = pa.schema(_arrow_fields(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            column = batch.column(len(keep))
            for lo, hi, buf, offs in chunks(column):
                made = [pa.array(x, type=t.type) if not isinstance(x, pa.Array) else x for x, t in zip(compute(buf, offs), types)]
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + made, names=[*keep, *types.names])

    return source.mapInArrow(run, schema)


def _arrow_fields(fields: StructType) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in fields]


def strings(buf: np.ndarray, offs: np.ndarray) -> list[str]:
    raw = buf.tobytes()
    return [raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]


def list_array(values: np.ndarray | pa.Array, counts: np.ndarray) -> pa.Array:
    """Lists of the given lengths over one flat array."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))
