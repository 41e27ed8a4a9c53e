"""Byte-level BPE with exact merges in linear time, and decoding by an offset table.

A vocabulary is a file of the tokenizers library (byte-level pre-tokenizer, merges in order of rank). A text is cut into pre-tokens
with array operations over its bytes. A pre-token is encoded by backtracking: at each place the longest token found by an Aho-Corasick
automaton is taken if it is compatible with the token before it, else the next shorter one, else the last token is taken back. Two
tokens are compatible when no merge across their border would have happened before the merges that made them; a sequence of tokens is
the BPE encoding exactly when all neighbours are compatible. Places that turned out dead are remembered, so work stays linear.

Equal pre-tokens of a chunk are encoded once, and recent ones are remembered by each Python worker, a bounded number of them.
"""

from __future__ import annotations

import functools
import json
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from pairwright.llm.texts import map_texts, span_hashes

#: Pre-tokens remembered by a worker.
REMEMBERED = 80_000
#: Rows decoded together.
DECODED_ROWS = 256
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@functools.lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = kind
    return table


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """For every byte the class of the character it belongs to."""
    table = char_classes()
    kinds = table[:256][buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = buf[lead].astype(np.int64)
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        code = b & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
        for k in (1, 2, 3):
            more = size > k
            code[more] = (code[more] << 6) | (buf[lead[more] + k] & 0x3F)
        kind = table[np.minimum(code, 0x10FFFF)]
        kinds[lead] = kind
        for k in (1, 2, 3):
            more = size > k
            kinds[lead[more] + k] = kind[more]
    return kinds


def pretoken_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions where the pre-tokens of some texts begin: contractions, words, numbers and signs with one
    space before them, runs of white space."""
    n = len(buf)
    kinds = byte_classes(buf)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    start = first.copy()
    start[1:n] |= kinds[1:] != kinds[:-1]
    start[n] = True
    at = np.flatnonzero(start)
    begins, ends = at[:-1], at[1:]
    kind = kinds[begins]
    white = (kind == SPACE) & ~first[ends]  # followed by something else in the same text
    a, b = begins[white], ends[white]
    last = b - 1
    for _ in range(2):
        last = last - ((buf[last] & 0xC0) == 0x80)
    start[last] = True
    joins = b[buf[last] == 0x20]
    start[joins] = False
    quote = begins[(kind == OTHER) & (ends - begins == 1) & (buf[begins] == 0x27) & ~first[ends]]
    quote = quote[start[quote]]
    quote = quote[kinds[quote + 1] == LETTER]
    if len(quote):
        padded = np.append(buf, [0, 0, 0])
        one, two = padded[quote + 1], padded[quote + 2]
        near = ~first[np.minimum(quote + 2, n)] & (quote + 2 < n)
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        long &= near & ~short
        for some, size in ((short, 2), (long, 3)):
            start[quote[some] + 1] = False
            start[quote[some] + size] = True
    return np.flatnonzero(start[:n])


def _load(path: str) -> tuple[dict, dict[bytes, int], list[bytes]]:
    """The model, the special tokens and the bytes of every token by id."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    ids = data["model"]["vocab"]
    special = {t["content"].encode(): t["id"] for t in data.get("added_tokens", [])}
    tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for name, k in ids.items():
        tokens[k] = bytes(byte[c] for c in name)
    for name, k in special.items():
        tokens[k] = name
    return data["model"], special, tokens


class OffsetTable:
    """The bytes of all tokens behind each other, and where each begins."""

    def __init__(self, path: str):
        _, _, tokens = _load(path)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens behind each other."""
        sizes = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(self.offsets[ids], sizes)]


class Vocabulary:
    """Tokens, merges, the automaton and the compatibility of pairs."""

    def __init__(self, path: str):
        model, self.special, self.tokens = _load(path)
        ids, size = model["vocab"], len(self.tokens)
        never = len(model["merges"]) + 1
        self.never = never
        self.rank, self.parts, self.made = {}, {}, [-1] * size
        for r, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b, c = ids[left], ids[right], ids[left + right]
            self.rank[a, b] = r
            if c not in self.parts:
                self.parts[c], self.made[c] = (a, b), r
        self.suffixes = [self._chain(k, 1) for k in range(size)]
        self.prefixes = [self._chain(k, 0) for k in range(size)]
        whole: list[bool] = [True] * size
        for c in sorted(self.parts, key=self.made.__getitem__):
            a, b = self.parts[c]
            whole[c] = whole[a] and whole[b] and self._holds(a, b, self.made[c])
        self.automaton = ahocorasick.Automaton()
        own = {name: k for k, name in enumerate(self.tokens) if name and k not in self.special.values() and whole[k]}
        for name, k in own.items():
            self.automaton.add_word(name.decode("latin-1"), (len(name), k))
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for name, k in own.items():
            self.shorter[k] = next((own[name[:n]] for n in range(len(name) - 1, 0, -1) if name[:n] in own), -1)
        self.known: dict[int, bool] = {}
        self.memory: dict[bytes, tuple[int, ...]] = {}
        self.lengths = [len(t) for t in self.tokens]

    def _chain(self, token: int, side: int) -> list[tuple[int, int]]:
        """The outer parts of a token, largest first, each with the rank of the merge that used it up."""
        out, used = [(token, self.never)], self.never
        while token in self.parts:
            used, token = self.made[token], self.parts[token][side]
            out.append((token, used))
        return out

    def _holds(self, a: int, b: int, before: int) -> bool:
        """No merge across the border of two tokens happens before the rank ``before``."""
        rank = self.rank
        for x, used_x in self.suffixes[a]:
            for y, used_y in self.prefixes[b]:
                r = rank.get((x, y))
                if r is not None and r < before and r < used_x and r <= used_y:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        ok = self.known.get(key)
        if ok is None:
            if len(self.known) > 3 * REMEMBERED:
                self.known.clear()
            ok = self.known[key] = self._holds(a, b, self.never)
        return ok

    def _backtrack(self, size: int, longest: list[int], base: int) -> tuple[int, ...]:
        tokens, shorter, offsets = [], self.shorter, self.lengths
        dead: set[int] = set()
        at, token = 0, longest[base]
        while True:
            while token >= 0:
                end = at + offsets[token]
                if end not in dead and (not tokens or self.compatible(tokens[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at = end
                if at == size:
                    return tuple(tokens)
                token = longest[base + at]
            else:
                dead.add(at)
                last = tokens.pop()
                at -= offsets[last]
                token = shorter[last]

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each pre-token."""
        memory = self.memory
        out = [memory.get(w) for w in words]
        new = [k for k, ids in enumerate(out) if ids is None]
        if new:
            if len(memory) > REMEMBERED:
                memory.clear()
            joined = "Ā".join(words[k].decode("latin-1") for k in new)
            longest = [-1] * len(joined)
            for end, (size, token) in self.automaton.iter(joined):
                longest[end - size + 1] = token
            base = 0
            for k in new:
                word = words[k]
                special = self.special.get(word)
                out[k] = memory[word] = (special,) if special is not None else self._backtrack(len(word), longest, base)
                base += len(word) + 1
        return out

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of some texts behind each other, and how many each has."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        raw = buf.tobytes()
        cuts, inside = [], np.zeros(len(buf) + 1, bool)
        for name in self.special:
            at = raw.find(name)
            while at >= 0:
                end = at + len(name)
                if np.searchsorted(offs, at, "right") == np.searchsorted(offs, end, "left"):  # not across two texts
                    cuts += [at, end]
                    inside[at + 1 : end] = True
                at = raw.find(name, end)
        starts = pretoken_starts(buf, np.union1d(offs, cuts).astype(np.int64) if cuts else offs)
        starts = starts[~inside[starts]] if cuts else starts
        ends = np.append(starts[1:], len(buf))
        hashes = span_hashes(buf, starts, ends)
        _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        found = self.encode_words([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        per = sizes[back]
        total = np.cumsum(per)
        ids = flat[np.arange(total[-1]) - np.repeat(total - per, per) + np.repeat(begin[back], per)]
        upto = np.concatenate([[0], total])[np.searchsorted(starts, offs)]
        return ids, np.diff(upto)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def offset_table(path: str) -> OffsetTable:
    return OffsetTable(path)


def encode(docs: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: str | None = None) -> DataFrame:
    """The columns ``keep``, ``n_tokens long`` and ``ids binary``: token ids as little-endian unsigned 32-bit integers; with
    ``decoded`` also a column of that name with the text decoded from the ids, as :func:`decode` gives it.

    Strings of special tokens inside a text become those tokens. A null or empty text has no tokens. ``path`` must be
    readable on every executor. Kept columns named like a result column give way to it.
    """

    def make():
        words = vocabulary(path)
        table = offset_table(path) if decoded else None

        def compute(buf, offs):
            ids, counts = words.encode(buf, offs)
            ends = np.concatenate([[0], np.cumsum(counts)])
            parts = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
            raw = ids.astype("<u4").tobytes()
            out = [counts, [raw[4 * a : 4 * b] for a, b in parts]]
            if table:
                out.append([table.decode(ids[a:b].astype(np.int64)).tobytes().decode("utf-8", "replace") for a, b in parts])
            return out

        return compute

    fields = "n_tokens bigint, ids binary" + (f", `{decoded}` string" if decoded else "")
    return map_texts(docs, text, make, StructType.fromDDL(fields), keep)


def decode(tokens: DataFrame, path: str, *, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The same rows with a column of the decoded text; bytes that are no UTF-8 become replacement characters, null ids an empty text."""
    names = [c for c in tokens.columns if c != to]
    source = tokens.select(*[f"`{c}`" for c in names])
    where = names.index(ids)

    def run(batches):
        table = offset_table(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(lo, DECODED_ROWS)
                texts = []
                for value in part.column(where).to_pylist():
                    texts.append(table.decode(np.frombuffer(value or b"", "<u4").astype(np.int64)).tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, to])

    return source.mapInArrow(run, StructType([*source.schema, *StructType.fromDDL(f"`{to}` string")]))
