"""Token ids in files: ranks by frequency in byte-aligned codes of variable length, with the control bytes apart from the data bytes.

An id is replaced by its rank among all ids of the corpus, the most frequent first, and the rank is stored in one to four bytes. Lengths stand in
control bytes, two bits for each of four ranks, so that a reader finds all places of a document by a table look-up and a running sum and
never tests a byte. Files are Parquet, one per shard: a shard is a range of documents in ascending order of their ids, a row a document with its
control bytes and data bytes; ``ranks`` beside the shards turns ranks back into ids. Spark commits a file when it is whole, so lost executors leave none in halves.

Texts are encoded with the tokenizers library. Its model here never merges across white space, so words are encoded one by one, equal
ones once; recent ones are remembered by each Python worker, a bounded number of them.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from pairwright.llm.store import written
from pairwright.llm.texts import BYTE_VALUE, LOWER_VALUE, map_texts, small_batches, span_hashes, spans_of

#: Words remembered by a worker.
REMEMBERED = 1_000_000
#: Ids coded or decoded together.
IDS_TOGETHER = 1 << 21
#: Values for every control byte: how many data bytes each of its four ranks has.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)

_SPACE = np.zeros(256, bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


class WordEncoder:
    """Ids of texts by a model that drops white space, reads A-Z as a-z and ends words with a mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        kinds = {x["type"] for x in data["normalizer"]["normalizers"]}
        end = data["model"]["end_of_word_suffix"]
        if "Lowercase" not in kinds or not end or data["post_processor"]:
            raise ValueError("this model is not one of lower-cased words")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"].encode() for t in data["added_tokens"]]
        self.ends = np.zeros(1 + max([*data["model"]["vocab"].values(), *(t["id"] for t in data["added_tokens"])]), bool)
        self.ends[[k for name, k in data["model"]["vocab"].items() if name.endswith(end)]] = True
        self.width = 2 if len(self.ends) <= 1 << 16 else 4
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def words_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words behind each other, and how many each has."""
        texts = [w.decode() for w in words]
        plain = [k for k, w in enumerate(texts) if w.isalpha()]
        other = [k for k, w in enumerate(texts) if not w.isalpha()]
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        for lo in range(0, len(plain), 500):  # words of letters only are encoded as one text: each ends with the one id that ends a word
            some = plain[lo : lo + 500]
            ids = np.array(self.library.encode_batch_fast([" ".join([texts[k] for k in some])], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):  # normalization made more than letters of some
                other += some
                continue
            for k, part in zip(some, np.split(ids, cuts[:-1])):
                found[k] = part
        for lo in range(0, len(other), 5000):
            some = other[lo : lo + 5000]
            for k, made in zip(some, self.library.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)):
                found[k] = np.array(made.ids, np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        ids, sizes = self.words_of(words)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(len(self.flat) + len(ids), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = np.cumsum(sizes) - sizes + self.used
        self.used += len(ids)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.sizes = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.sizes, place, sizes)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts behind each other, and how many each has."""
        raw = buf.tobytes()
        exact = any(name in raw for name in self.special)  # those strings are ids of their own in this case only
        letter, mark = _LETTER[buf], _MARK[buf]
        starts, ends, _ = spans_of(~_SPACE[buf], offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        cut = np.flatnonzero((letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])) + 1  # no pre-token has both
        cut = np.setdiff1d(cut, starts, assume_unique=True)
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        hashes = ~span_hashes(buf, starts, ends, BYTE_VALUE) if exact else span_hashes(buf, starts, ends, LOWER_VALUE)
        one, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = self._places(one)
        new = np.flatnonzero(at < 0)
        if len(self.keys) + len(new) > REMEMBERED:
            self._forget()
            new = np.arange(len(one))
        if len(new):
            pairs = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            self._learn(one[new], [raw[a:b] for a, b in pairs])
            at = self._places(one)
        begin, per = self.at[at][back], self.sizes[at][back]
        total = np.cumsum(per)
        ids = self.flat[np.arange(total[-1]) - np.repeat(total - per, per) + np.repeat(begin, per)]
        upto = np.concatenate([[0], total])[np.searchsorted(starts, offs)]
        return ids, np.diff(upto)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash is remembered, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokens(docs: DataFrame, path: str, *, id_column: str = "doc_id", text: str = "text", end: int | None = None) -> DataFrame:
    """``(doc_id, ids)``: the ids of every whole text as little-endian unsigned integers of :func:`width` bytes, ``end`` behind them if given.

    A null or empty text has no other ids; strings of special tokens inside a text are those tokens, as the library has it. Repeated
    rows and null ids stay rows of their own; extra columns are not read. ``path`` must be readable on every executor.
    """

    def make():
        words = encoder(path)
        kind = np.dtype(f"<u{words.width}")

        def compute(buf, offs):
            ids, counts = words.encode(buf, offs)
            if end is not None:
                ids, counts = np.insert(ids, np.cumsum(counts), end), counts + 1
            return [_binaries(ids.astype(kind).view(np.uint8), counts * kind.itemsize)]

        return compute

    source = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_texts(source, "text", make, StructType.fromDDL("ids binary"), ("doc_id",))


def width(path: str) -> int:
    return encoder(path).width


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column behind each other, and where each value begins."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offs[0] : offs[-1]], offs - offs[0]


def coded(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and their number for each document, data bytes and their number; the documents' ranks stand behind each other."""
    ranks = ranks.astype(np.int64)
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    upto = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(int(upto[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        long = np.flatnonzero(size > k)
        data[upto[long] + k] = (ranks[long] >> 8 * k) & 0xFF
    controls = -(-counts // 4)
    lengths = np.zeros(4 * int(controls.sum()), np.uint8)
    lengths[_slots(counts, controls)] = size - 1
    control = lengths[0::4] | lengths[1::4] << 2 | lengths[2::4] << 4 | lengths[3::4] << 6
    ends = np.concatenate([[0], np.cumsum(counts)])
    return control, controls, data, np.diff(upto[ends])


def _slots(counts: np.ndarray, controls: np.ndarray) -> np.ndarray:
    """The places of all ranks among the slots of the control bytes; each document begins with a byte of its own."""
    skipped = 4 * controls - counts
    return np.arange(int(counts.sum())) + np.repeat(np.cumsum(skipped) - skipped, counts)


def ranks_of(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What :func:`coded` was given."""
    size = LENGTHS[control].reshape(-1)[_slots(counts, -(-counts // 4))].astype(np.int64)
    begin = np.cumsum(size) - size
    out = data[begin].astype(np.uint32)
    for k in range(1, int(size.max(initial=0))):
        long = np.flatnonzero(size > k)
        out[long] |= data[begin[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _pieces(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents with some ids together, or one longer document."""
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - counts[lo] + IDS_TOGETHER, "right")))
        yield lo, hi
        lo = hi


def frequencies(table: DataFrame, width: int, ids: str = "ids") -> DataFrame:
    """``(id, n)`` of all ids in a column of little-endian integers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            found = _flat(batch.column(0))[0].view(f"<u{width}")
            if width <= 2:
                m = np.bincount(found)
                more = np.flatnonzero(m)
                m = m[more]
            else:
                more, m = np.unique(found, return_counts=True)
            some, back = np.unique(np.concatenate([some, more.astype(np.int64)]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([n, m]), minlength=len(some)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n)], names=["id", "n"])

    return table.select(ids).mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(table: DataFrame, path: str, width: int, shards: int | None = None) -> str:
    """Write the documents ``(doc_id, ids)`` below ``path``: ``shards`` in ascending order of ``doc_id`` (null first, equal ones by a hash of
    their ids), and ``ranks``. The table is read three times, so give one that is stored.

    Only the ranks pass through the driver, at most one row for each id of the vocabulary. A ``doc_id`` that very many rows share is spread over
    several shards.
    """
    spark = table.sparkSession
    small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = frequencies(table, width).orderBy(F.desc("n"), "id").toArrow()
    ids = ranked.column("id").to_numpy()
    spark.createDataFrame(ranked.append_column("rank", pa.array(np.arange(len(ids), dtype=np.int64)))).coalesce(1).write.parquet(f"{path}/ranks")
    by_id = np.argsort(ids)
    shared = spark.sparkContext.broadcast((ids[by_id], by_id))
    ordered = table.select("doc_id", "ids", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = ordered.repartitionByRange(shards, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    fields = StructType([StructType.fromDDL("shard int")[0], table.schema["doc_id"], *StructType.fromDDL("before bigint, n_tokens bigint, control binary, data binary")])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        known, rank = shared.value
        table = None
        if len(known) and known[-1] < 1 << 22:  # a direct table is faster than a search
            table = np.zeros(int(known[-1]) + 1, np.uint32)
            table[known] = rank
        for batch in batches:
            flat, offs = _flat(batch.column(2))
            every = flat.view(f"<u{width}")
            ends = offs // width
            counts = np.diff(ends)
            for lo, hi in _pieces(counts):
                some, ids = counts[lo:hi], every[ends[lo] : ends[hi]]
                control, controls, data, sizes = coded(table[ids] if table is not None else rank[np.searchsorted(known, ids)], some)
                upto = before + np.cumsum(some) - some
                before += int(some.sum())
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(upto), pa.array(some), _binaries(control, controls), _binaries(data, sizes)], names=[f.name for f in fields])

    numbered = ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "ids")
    numbered.mapInArrow(code, fields).write.parquet(f"{path}/shards")
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of the files that :func:`write_ids` made: ids as little-endian unsigned 32-bit integers, ``start`` the number
    of ids of all documents before."""
    files = spark.read.parquet(f"{path}/shards")
    small_batches(spark)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toArrow()
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row per shard
    bases, total = {}, 0
    for row in totals:
        bases[row["shard"]] = total
        total += row["n"]
    shared = spark.sparkContext.broadcast((ranks.column("id").to_numpy().astype("<u4"), bases))
    fields = StructType([files.schema["doc_id"], *StructType.fromDDL("start bigint, n_tokens bigint, ids binary")])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of, base = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = batch.column(3).to_numpy()
            start = np.array([base[s] for s in batch.column(0).to_pylist()], np.int64) + batch.column(2).to_numpy()
            control, c = _flat(batch.column(4))
            data, d = _flat(batch.column(5))
            for lo, hi in _pieces(counts):
                ids = id_of[ranks_of(control[c[lo] : c[hi]], data[d[lo] : d[hi]], counts[lo:hi])]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(start[lo:hi]), pa.array(counts[lo:hi]), _binaries(ids.view(np.uint8), 4 * counts[lo:hi])], names=[f.name for f in fields])

    return files.select("shard", "doc_id", "before", "n_tokens", "control", "data").mapInArrow(decode, fields)


def stored_tokens(table: DataFrame) -> DataFrame:
    """The table of :func:`tokens`, written once."""
    spark = table.sparkSession
    name = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(name)
    spark.conf.set(name, "zstd")
    try:
        return written(table, "token-ids")
    finally:
        spark.conf.set(name, before)
