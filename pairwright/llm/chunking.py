"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a place depends on the 32 bytes before it. A cut is the place with the smallest hash of any ``window`` places in a row,
so cuts depend on nearby bytes only: an insertion moves the cuts around it and no others, a passage is cut alike wherever it stands, and no
``window`` places of ordinary text are without a cut. A smallest hash that occurs twice is no cut. Chunks longer than ``most`` are cut every
``most`` bytes from their start.

A chunk is compared by a 128-bit digest of its bytes and the ``LEAD`` bytes before them, which decide its first cut and so are part of every
passage that the chunk is cut alike in. Chunks are compared over the whole corpus; those of the document with the smallest id stay. Chunks that a text
itself holds before are reported apart, whether or not another document has them, so that the comparison of documents does not depend on them.
Adjacent repeated chunks form a run, and runs that make at least ``run_bytes`` with the bytes before them are repeated passages; shorter
runs are ordinary phrases and stay. A passage of ``run_bytes + 2 * window - 2`` bytes (190) always holds such a run. Text that repeats one short unit for long has no cuts, or one in every unit, and is
matched only where whole chunks agree.

Counts per digest combine before their shuffle, and the join back to the documents is an ordinary one, whose skewed side Spark splits, so a line
that every document holds is never gathered in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.llm.texts import BYTE_VALUE, chunks, list_array, map_texts, mix, span_hashes

#: Places of which the one with the smallest hash is a cut; a power of two.
WINDOW = 64
#: Bytes before a chunk that count as part of it: those its first gear hash is made of.
LEAD = 32
MOST = 1024
RUN_BYTES = 64

_GEAR = (BYTE_VALUE >> np.uint64(32)).astype(np.uint32)
_SECOND = mix(BYTE_VALUE ^ np.uint64(0x5851F42D4C957F2D))


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """At every byte, sum of the gear values of the last 32 bytes, each doubled once per byte since."""
    out = _GEAR[buf]
    step = 1
    while step < 32:  # the sum over 2n bytes from two sums over n
        moved = out.copy()
        moved[step:] += out[:-step] << np.uint32(step) if step < len(out) else 0
        out = moved
        step *= 2
    return out


def _sliding(values: np.ndarray, window: int, best: np.ufunc) -> np.ndarray:
    """Best of the ``window`` values from each place on; as many places fewer."""
    step = 1
    while step < window:
        values = best(values[:-step], values[step:])
        step *= 2
    return values


def chunk_starts(buf: np.ndarray, offs: np.ndarray, window: int = WINDOW, most: int = MOST) -> np.ndarray:
    """Byte positions where chunks begin; every text begins one."""
    if window < 1 or window & (window - 1):
        raise ValueError("window is a power of two")
    if not len(buf):
        return np.zeros(0, np.int64)
    places = np.zeros(0, np.int64)
    first, behind = offs[:-1] + LEAD - 1, offs[1:] - window + 1  # windows of a text whose hashes see that text only
    some = first < behind
    if some.any():
        hashes = gear_hashes(buf)
        edges = np.zeros(len(buf) + 1, np.int8)
        edges[first[some]], edges[behind[some]] = 1, -1
        low = _sliding(hashes, window, np.minimum)
        low[np.cumsum(edges[: len(low)], dtype=np.int8) == 0] = 0
        none = np.zeros(window - 1, np.uint32)
        held = _sliding(np.concatenate([none, low, none]), window, np.maximum)  # the best window that holds a place
        at = np.flatnonzero((held == hashes) & (hashes > 0))
        same = (np.diff(at) < window) & (hashes[at[1:]] == hashes[at[:-1]])
        places = at[~(np.append(same, False) | np.append(False, same))] + 1 if len(at) else at
    cuts = np.union1d(places[places < len(buf)], offs[:-1][np.diff(offs) > 0])
    ends = np.append(cuts[1:], len(buf))
    extra = (ends - cuts - 1) // most
    if extra.any():
        again = np.repeat(cuts, extra) + most * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
        cuts = np.union1d(cuts, again)
    return cuts.astype(np.int64)


CHUNK = "hi bigint, lo bigint, start int, size int"


def _digests(buf, offs, window: int, most: int) -> tuple[np.ndarray, ...]:
    """Of every chunk: text number, start, end, where its compared bytes begin, and both halves of its digest."""
    starts = chunk_starts(buf, offs, window, most)
    ends = np.append(starts[1:], len(buf)) if len(starts) else starts
    doc = np.searchsorted(offs, starts, "right") - 1
    begins = np.maximum(starts - LEAD, offs[doc])
    hi, lo = (span_hashes(buf, begins, ends, values).view(np.int64) for values in (BYTE_VALUE, _SECOND))
    return doc, starts, ends, begins, hi, lo


def _chunked(window: int, most: int):
    def compute(buf, offs):
        doc, starts, ends, _, hi, lo = _digests(buf, offs, window, most)
        flat = pa.StructArray.from_arrays(
            [pa.array(hi), pa.array(lo), pa.array((starts - offs[doc]).astype(np.int32)), pa.array((ends - starts).astype(np.int32))],
            names=["hi", "lo", "start", "size"],
        )
        return [list_array(flat, np.bincount(doc, minlength=len(offs) - 1))]

    return compute


INNER = "n_bytes bigint, n_chunks bigint, n_inner bigint, inner_bytes bigint, inner array<struct<start int, end int>>"


def _inner(window: int, most: int, run_bytes: int):
    def compute(buf, offs):
        n = len(offs) - 1
        doc, _, ends, begins, hi, lo = _digests(buf, offs, window, most)
        n_chunks = np.bincount(doc, minlength=n)
        order = np.lexsort((lo, hi, doc))  # stable: equal chunks of a text stay in their order
        same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (doc, hi, lo)])
        later = np.sort(order[1:][same])
        doc, ends, begins = doc[later], ends[later], begins[later]
        opens = np.flatnonzero(np.append(True, (begins[1:] > ends[:-1]) | (doc[1:] != doc[:-1]))) if len(later) else later
        closes = np.append(opens[1:], len(later))[: len(opens)]
        long = ends[closes - 1] - begins[opens] >= run_bytes
        opens, closes = opens[long], closes[long]
        of, a, b = doc[opens], begins[opens], ends[closes - 1]
        spans = pa.StructArray.from_arrays([pa.array((x - offs[of]).astype(np.int32)) for x in (a, b)], names=["start", "end"])
        sums = [np.bincount(of, weights=x, minlength=n).astype(np.int64) for x in (closes - opens, b - a)]
        return [np.diff(offs), n_chunks, *sums, list_array(spans, np.bincount(of, minlength=n))]

    return compute


def inner_passages(docs: DataFrame, text: str, window: int, most: int, run_bytes: int, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` with ``n_bytes, n_chunks`` and the passages that the row's own text holds before: ``n_inner`` chunks,
    ``inner_bytes`` and ``inner``, an array of ``(start, end)`` in bytes. The first copy in a text is none of them."""
    return map_texts(docs, text, lambda: _inner(window, most, run_bytes), StructType.fromDDL(INNER), keep)


def _rows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``(doc_id, row, text)``; ``row`` tells apart rows that repeat an id with different texts."""
    plain = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(plain).alias("row"), plain.alias("text"))


def chunks_of(docs: DataFrame, id_column: str, text: str, window: int, most: int) -> DataFrame:
    """``(doc_id, row, chunks)``: digest with the bytes before, place and size in bytes of all chunks of a text."""
    return map_texts(_rows(docs, id_column, text), "text", lambda: _chunked(window, most), StructType.fromDDL(f"chunks array<struct<{CHUNK}>>"), ("doc_id", "row"))


def repeated_passages(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    most: int = MOST,
    run_bytes: int = RUN_BYTES,
) -> DataFrame:
    """One row per row: ``doc_id, n_bytes, n_chunks, n_shared`` (chunks in passages that occur elsewhere as well), ``n_removed`` (chunks in
    passages whose first occurrence is elsewhere), ``shared_bytes, removed_bytes`` and ``removed``, an array of ``(start, end)`` in bytes;
    then ``n_inner, inner_bytes`` and ``inner`` likewise for later copies of passages inside the text of a row itself. A place may be in both arrays.

    A null or empty text has no chunks. Rows that repeat an id are one document in that nothing they share among themselves is
    repeated elsewhere; each is judged by the places of its own text, and equal rows get equal results. Rows without an id are left out of the comparison and have nothing to remove.
    Extra columns are not read.
    """
    found = _judged(docs, id_column, text, window, most, run_bytes)
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_shared", "n_removed", "shared_bytes", "removed_bytes")]
    inner = inner_passages(_rows(docs, id_column, text), "text", window, most, run_bytes, ("doc_id", "row"))
    joined = inner.join(found.withColumnsRenamed({"doc_id": "d", "row": "r"}), (F.col("doc_id") == F.col("d")) & (F.col("row") == F.col("r")), "left")
    named, none = F.col("doc_id").isNotNull(), F.array().cast("array<struct<start:int,end:int>>")
    own = [F.when(named, F.col(c)).otherwise(0).alias(c) for c in ("n_inner", "inner_bytes")]
    return joined.select("doc_id", "n_bytes", "n_chunks", *counts, F.coalesce("removed", none).alias("removed"), *own, F.when(named, F.col("inner")).otherwise(none).alias("inner"))


def _judged(docs: DataFrame, id_column: str, text: str, window: int, most: int, run_bytes: int) -> DataFrame:
    """``(doc_id, row, n_shared, n_removed, shared_bytes, removed_bytes, removed)`` of the rows that share chunks with another document, equal rows once."""
    flat = chunks_of(docs, id_column, text, window, most).where("doc_id IS NOT NULL").select("doc_id", "row", F.inline("chunks"))
    known = flat.groupBy("hi", "lo").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc <> last_doc")
    known = known.select(F.col("hi").alias("h"), F.col("lo").alias("l"), "first_doc")
    met = flat.join(known, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")))
    packed = F.struct("start", "size", (F.col("doc_id") == F.col("first_doc")).alias("own"))
    found = met.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(packed)).alias("c"))  # a set: equal rows add nothing
    fields = StructType.fromDDL("doc_id bigint, row bigint, n_shared bigint, n_removed bigint, shared_bytes bigint, removed_bytes bigint, removed array<struct<start int, end int>>")
    fields.fields[0].dataType = docs.schema[id_column].dataType
    return found.mapInArrow(_passages(run_bytes), fields)


def _passages(run_bytes: int):
    """Runs of adjacent repeated chunks of each document with the bytes before them, and those of chunks that another document has first."""

    def runs_of(places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for a, b in places:
            a = max(a - LEAD, 0)
            if out and out[-1][1] >= a:
                out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2] + 1)
            else:
                out.append((a, b, 1))
        return [r for r in out if r[1] - r[0] >= run_bytes]

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for chunks in batch.column("c").to_pylist():
                places = [(c["start"], c["start"] + c["size"]) for c in chunks]
                every, gone = runs_of(places), runs_of([p for p, c in zip(places, chunks) if not c["own"]])
                for values, x in zip(columns, (sum(r[2] for r in every), sum(r[2] for r in gone), sum(b - a for a, b, _ in every), sum(b - a for a, b, _ in gone))):
                    values.append(x)
                columns[4].append([{"start": a, "end": b} for a, b, _ in gone])
            kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            names = ["doc_id", "row", "n_shared", "n_removed", "shared_bytes", "removed_bytes", "removed"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *(pa.array(v, k) for v, k in zip(columns, kinds))], names=names)

    return run


def without_passages(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with later occurrences of repeated passages, of other documents and of their own, cut out of ``text``; a null text stays null.

    Every row is cut at the places of its own text, also where rows repeat an id. A cut inside a character of several bytes moves to that character's end, so what is left is valid text.
    """
    sizes = [options.get(name, usual) for name, usual in (("window", WINDOW), ("most", MOST), ("run_bytes", RUN_BYTES))]
    found = _judged(docs, id_column, text, *sizes).where(F.size("removed") > 0)
    cuts = found.select(F.col("doc_id").alias("__d__"), F.col("row").alias("__r__"), F.col("removed").alias("__cut__"))
    mine = (F.col(f"`{id_column}`") == F.col("__d__")) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col("__r__"))
    joined = docs.join(cuts, mine, "left")
    at, named = docs.columns.index(text), docs.columns.index(id_column)

    def run(batches):
        compute = _inner(*sizes)
        for batch in batches:
            own = [spans for _, _, buf, offs in chunks(batch.column(at)) for spans in compute(buf, offs)[-1].to_pylist()]
            rows = zip(batch.column(at).to_pylist(), batch.column(len(batch.columns) - 1).to_pylist(), own, batch.column(named).is_valid().to_pylist())
            cuts = [(x, sorted((cut or []) + inner, key=lambda s: s["start"]) if x is not None and known else []) for x, cut, inner, known in rows]
            texts = [_cut(x.encode(), cut) if cut else x for x, cut in cuts]
            columns = [pa.array(texts, batch.column(k).type) if k == at else batch.column(k) for k in range(len(batch.columns) - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.drop("__d__", "__r__").mapInArrow(run, docs.schema)


def _cut(data: bytes, spans: list[dict]) -> str:
    out, at = [], 0
    for span in spans:
        start, end = (_edge(data, min(x, len(data))) for x in (span["start"], span["end"]))
        out.append(data[at:start])
        at = max(at, end)
    return b"".join([*out, data[at:]]).decode()


def _edge(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def spans_text(spans: Column) -> Column:
    """``start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
