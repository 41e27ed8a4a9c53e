"""Collocations: frequent phrases by mergeable Misra-Gries summaries, counted exactly in a second pass.

Phrases of one word, then of two, then of three and more pass through a round each. A task sums the phrases of its texts; the sums go to
hash partitions, whose total mass is known before any summary is built. The summary of a partition holds more counters than its
mass divided by the threshold, so what it takes off a count stays below the threshold: every phrase at or above the threshold survives.
Survivors are those whose count and all that was taken off reach the threshold together.

A round reads only phrases whose shorter parts survived the round before. Survivors travel as a bit per hash in a filter of fixed size:
it lets some others through and never stops a survivor. When survivors outgrow the filter, it stops fewer phrases and more of them are shuffled;
results stay the same. The second pass counts the phrases that pass the filter by their words, not by their hashes, in the
same way: sums of tasks, added up in hash partitions that hold no more than their own phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.llm.store import written
from pairwright.llm.texts import chunks, mix, small_batches, span_hashes, spans_of

THRESHOLD = 100
MAX_WORDS = 5
TOP = 2000
#: Bits of the filter of survivors, as a power of two: 4 MB that every task holds, whatever the size of the corpus.
FILTER_BITS = 25
#: Phrases a task gathers before it sums them, and different ones it holds before it passes them on.
GATHERED = 1 << 21
CHUNK = 1 << 21

IS_BREAK = np.zeros(256, bool)
IS_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Phrases:
    """The words of some texts, and hashes of the phrases that begin at each."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, langs: np.ndarray):
        self.low = LOWER[buf]
        breaks = IS_BREAK[self.low]
        self.starts, self.ends, self.first = spans_of(~(breaks | IS_SPACE[self.low]), offs)
        n = len(self.starts)
        #: whether a word goes on with the piece of the word before it
        self.joined = np.zeros(n, bool)
        if n:
            seen = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(breaks, out=seen[1:])
            self.joined[1:] = seen[self.starts[1:]] == seen[self.ends[:-1]]
            heads = self.first[:-1]
            self.joined[heads[heads < n]] = False
        self.words = span_hashes(self.low, self.starts, self.ends)
        self.per_text = np.diff(self.first)
        self.lang = np.repeat(langs, self.per_text)

    def hashes(self, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2, .. ``upto`` words: the hash of the phrase from each word on, and whether it lies within a piece."""
        known, inside = mix(self.words ^ mix(self.lang)), np.ones(len(self.words), bool)
        for size in range(1, upto + 1):
            if size > 1:
                n = max(0, len(self.words) - size + 1)
                known = mix(known[:n] * _STEP + self.words[size - 1 :])
                inside = inside[:n] & self.joined[size - 1 :]
            yield known, inside


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter has a bit for each hash."""
    slot = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _allowed(phrases: Phrases, upto: int, filters: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(words, hashes, may be frequent)`` of all phrase lengths, judged by the filters of the shorter phrases there are."""
    before = alone = None
    for size, (known, inside) in enumerate(phrases.hashes(upto), 1):
        ok = inside
        if size == 2 and filters:
            ok = inside & alone[:-1] & alone[1:] if len(inside) else inside
        elif size > 2 and len(filters) > 1:
            n = len(inside)
            ok = inside & before[:n] & pair[size - 2 : size - 2 + n]
        yield size, known, ok
        if size == 1 and filters:
            alone = passes(filters[0], known)
        if size == 2 and len(filters) > 1:
            pair = ok & passes(filters[1], known)
            ok = pair
        before = ok


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, back = np.unique(hashes, return_inverse=True)
    return one, np.bincount(back, weights=counts, minlength=len(one)).astype(np.int64) if len(one) else np.zeros(0, np.int64)


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters; what merging took off every count is in ``lost``."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = _summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(keys) > self.capacity:
            cut = len(counts) - self.capacity - 1
            off = int(np.partition(counts, cut)[cut])  # the largest count that has no counter
            self.lost += off
            stay = counts > off
            keys, counts = keys[stay], counts[stay] - off
        self.keys, self.counts = keys, counts

    def survivors(self, threshold: int) -> np.ndarray:
        return self.keys[self.counts + self.lost >= threshold]


def _lang_hashes(column: pa.Array) -> np.ndarray:
    coded = column.dictionary_encode()
    names = np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()], np.uint64)
    return names[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, np.uint64)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    small_batches(docs.sparkSession)
    plain = lambda c, missing: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing))
    return docs.select(plain(lang, "und").alias("lang"), plain(text, "").alias("text"))


def _dealt(rows: DataFrame, parts: int, *order: str) -> DataFrame:
    """Rows of a hash partition behind each other in one task."""
    return rows.repartition(parts, "part").sortWithinPartitions("part", *order)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for some in np.split(order, cuts):
        if len(some):
            yield int(part[some[0]]), some


def _round(texts: DataFrame, sizes: tuple[int, ...], filters: list[np.ndarray], threshold: int, parts: int, filter_bits: int) -> np.ndarray:
    """The filter of the phrases of these lengths that survive their hash partition's summary.

    A task sends each partition a first row with the mass it has for it, and its sums as binaries: 48 bits of each hash (equal ones only add
    survivors) and a count. First rows sort before all others, so that the capacity is known when the first sums arrive.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(filters)
    modulo = np.uint64(parts)
    fields = "part int, sums int, mass bigint, grams binary, counts binary"
    names = ["part", "sums", "mass", "grams", "counts"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, n = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0

        def combined() -> tuple[np.ndarray, np.ndarray]:
            found = np.concatenate([held[0], *waiting])
            ones = np.ones(len(found) - len(held[0]), np.int64)
            return _summed(found, np.concatenate([held[1], ones]))

        def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            made = []
            for part, some in _by_part(((keys >> np.uint64(32)) % modulo).astype(np.int64)):
                n = counts[some]
                short = np.ascontiguousarray(keys[some].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                made += [(part, 0, int(n.sum()), None, None), (part, 1, None, short.tobytes(), n.astype("<u4").tobytes())]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=names)

        for batch in batches:
            langs = _lang_hashes(batch.column(0))
            for lo, hi, buf, offs in chunks(batch.column(1), CHUNK):
                for size, hashes, ok in _allowed(Phrases(buf, offs, langs[lo:hi]), max(sizes), shared.value):
                    if size in sizes:
                        waiting.append(hashes[ok])
                        n += len(waiting[-1])
                if n >= GATHERED:
                    held, waiting, n = combined(), [], 0
                    if len(held[0]) >= GATHERED:
                        yield from rows(*held)
                        held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield from rows(*combined())

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mass, summary, keys, counts, n = -1, 0, None, [], [], 0

        def flush() -> None:
            nonlocal keys, counts, n
            if n:
                summary.merge(np.concatenate(keys), np.concatenate(counts))
            keys, counts, n = [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if summary is not None:
                flush()
                found = summary.survivors(threshold)
                for lo in range(0, len(found), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(found[lo : lo + (1 << 16)].view(np.int64))], names=["gram"])

        for batch in batches:
            for part, body, more, grams, count in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    yield from done()
                    at, mass, summary = part, 0, None
                if not body:
                    mass += more
                    continue
                summary = summary or Summary(mass // threshold + 1)
                whole = np.zeros((len(grams) // 6, 8), np.uint8)
                whole[:, :6] = np.frombuffer(grams, np.uint8).reshape(-1, 6)
                keys.append(whole.view("<u8").reshape(-1))
                counts.append(np.frombuffer(count, "<u4").astype(np.int64))
                n += len(counts[-1])
                if n >= max(1 << 17, summary.capacity):
                    flush()
        yield from done()

    dealt = _dealt(texts.mapInArrow(sums, fields), parts, "sums")
    word = F.shiftrightunsigned(F.col("gram").bitwiseAND(F.lit((1 << filter_bits) - 1)), 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("gram").bitwiseAND(F.lit(63)).cast("int"))
    ored = dealt.mapInArrow(survivors, "gram bigint").groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (filter_bits - 6), np.int64)
    bits[ored.column("word").to_numpy()] = ored.column("bits").to_numpy()
    return bits.view(np.uint8)


def phrase_counts(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, max_words: int = MAX_WORDS, parts: int | None = None, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """``(lang, phrase, words, n)`` of every phrase of 1 to ``max_words`` words found ``threshold`` times or more in texts of its
    language, and one row per language with an empty phrase, 0 words and the number of all its words.

    A-Z are read as a-z. Marks ``. , ; : ! ?`` and line ends cut a text into pieces, spaces and tabs a piece into words; phrases lie in one piece
    and may overlap. A null language is ``und``, a null text empty. Repeated rows count as often as they stand there; extra columns are not
    read. An empty table gives no rows. ``parts`` is the number of hash partitions, by default four for each shuffle partition.
    """
    spark = docs.sparkSession
    texts = _texts(docs, text, lang)
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    filters: list[np.ndarray] = []
    for sizes in ((1,), (2,), tuple(range(3, max_words + 1))):
        if sizes and sizes[0] <= max_words:
            filters.append(_round(texts, sizes, filters, threshold, parts, filter_bits))
    shared = spark.sparkContext.broadcast(filters)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        names: list[tuple[str, str, int]] = []
        counts, total = np.zeros(0, np.int64), {}

        def rows() -> Iterator[pa.RecordBatch]:
            every = [*names, *((lang, "", 0) for lang in total)]
            n = np.concatenate([counts[: len(names)], np.fromiter(total.values(), np.int64, len(total))])
            part = np.array([xxhash.xxh32_intdigest(f"{lang}\n{phrase}") % parts for lang, phrase, _ in every], np.int64)
            made = []
            for k, some in _by_part(part):
                langs, phrases, words = zip(*[every[i] for i in some.tolist()])
                made.append((k, langs, phrases, words, n[some].tolist()))
            if made:
                kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=["part", "langs", "phrases", "words", "ns"])

        for batch in batches:
            column = batch.column(0)
            langs = _lang_hashes(column)
            label = column.to_pylist()
            for lo, hi, buf, offs in chunks(batch.column(1), CHUNK):
                found = Phrases(buf, offs, langs[lo:hi])
                owner = np.repeat(np.arange(lo, hi), found.per_text)
                for name, n in zip(label[lo:hi], found.per_text.tolist()):
                    total[name] = total.get(name, 0) + n
                raw, starts, ends = found.low.tobytes(), found.starts, found.ends
                for size, hashes, ok in _allowed(found, max_words, shared.value):
                    at = np.flatnonzero(ok)
                    at = at[passes(shared.value[min(size, 3) - 1], hashes[at])]
                    one, first, n = np.unique(hashes[at], return_index=True, return_counts=True)
                    slots = np.empty(len(one), np.int64)
                    for k, key in enumerate(one.tolist()):
                        slot = known.get(key)
                        if slot is None:
                            i = int(at[first[k]])
                            slot = known[key] = len(names)
                            names.append((label[owner[i]], b" ".join([raw[a:b] for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist())]).decode(), size))
                        slots[k] = slot
                    if len(names) > len(counts):
                        counts = np.concatenate([counts, np.zeros(max(len(names) - len(counts), len(counts)), np.int64)])
                    counts[slots] += n
                if len(names) >= GATHERED // 8:
                    yield from rows()
                    known, names, counts, total = {}, [], np.zeros(0, np.int64), {}
        yield from rows()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = -1, None

        def done() -> Iterator[pa.RecordBatch]:
            if held is not None:
                yield from held.filter((pc.field("words") == 0) | (pc.field("n") >= threshold)).to_batches()

        for batch in batches:
            for k, part in enumerate(batch.column(0).to_pylist()):
                lists = [batch.column(i).slice(k, 1).flatten() for i in range(1, 5)]
                more = pa.table(lists, names=["lang", "phrase", "words", "n"])
                if part != at:
                    yield from done()
                    at, held = part, None
                both = more if held is None else pa.concat_tables([held, more])
                held = both.group_by(["lang", "phrase", "words"], use_threads=False).aggregate([("n", "sum")]).rename_columns(more.column_names)
        yield from done()

    sent = texts.mapInArrow(exact, "part int, langs array<string>, phrases array<string>, words array<int>, ns array<bigint>")
    return _dealt(sent, parts).mapInArrow(total, StructType.fromDDL("lang string, phrase string, words int, n bigint"))


def collocations(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, max_words: int = MAX_WORDS, percent: int = 100, top: int = TOP, parts: int | None = None, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of two words and more.

    A phrase found ``a`` times is cut where ``1000 * a * n / (l * r)``, rounded down, is lowest (at the fewest words where that ties); ``l`` and
    ``r`` count its two sides, ``n`` the words of the language. Phrases inside a longer one that is found ``percent`` percent as often or
    more are left out. Ranked by score, ``a`` (both falling) and the phrase's bytes. Numbers are exact: products are decimals of 38 digits.
    Nulls, repeated rows, extra columns and empty tables: see :func:`phrase_counts`.
    """
    counts = written(phrase_counts(docs, text=text, lang=lang, threshold=threshold, max_words=max_words, parts=parts, filter_bits=filter_bits), "phrases")
    grams = counts.where("words > 0")
    found = grams.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    part = lambda n: F.call_function("substring_index", F.col("phrase"), F.lit(" "), n)  # noqa: E731  n words from the left, or from the right where negative
    inner = [part(F.col("words") - 1), part(1 - F.col("words"))]
    longest = found.where("words > 2").select("lang", F.explode(F.array(*inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = found.join(longest, ["lang", "phrase"], "left").where(f"longest IS NULL OR 100 * longest < {int(percent)} * a").drop("longest")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", part(F.col("k")).alias("left"), part(F.col("k") - F.col("words")).alias("right"))
    side = lambda part, n: grams.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    cuts = cuts.join(counts.where("words = 0").select("lang", "n"), "lang")
    long = lambda c: F.col(c).cast("decimal(19,0)")
    product = F.lit(1000).cast("decimal(4,0)") * long("a") * long("n")
    scores = cuts.withColumn("score", F.call_function("div", product, long("l") * long("r")))  # whole quotient
    best = scores.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

