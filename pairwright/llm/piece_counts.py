"""Token counts of a sentencepiece BPE model by whole-token shortcuts.

A text becomes the model's form: one space in front, every space a word mark. No piece holds a word mark behind another character
(checked when the model is loaded), so merges never cross the front of a run of spaces, and a text splits into pre-tokens there.
Which vocabulary strings encode alone as one token is proved once per model, by merging each. Pre-tokens that
are such strings count 1 by a look-up; the rest is merged, equal ones of a chunk once, and recent ones are remembered.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.llm.texts import map_texts, span_hashes

REMEMBERED = 100_000
#: Symbols of a part that is merged with a heap; longer pre-tokens are not remembered either.
LONG_PART = 512
MARK = "▁"
LIMIT = 4096
_NEVER = 1 << 30


class Pieces:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [k for k in range(n) if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k) or model.is_unused(k))]
        score = {model.id_to_piece(k).replace(MARK, " "): model.get_score(k) for k in plain}
        if any(" " in p.lstrip(" ") for p in score):
            raise ValueError("a piece of this model holds a word mark behind another character")
        chars = sorted({c for p in score for c in p} - set(score))
        number = {p: k for k, p in enumerate([*score, *chars])}
        self.n_pieces = len(score)
        #: symbol of every character; those of no piece share the number behind all others
        self.char_symbol = np.full(0x110000, len(number), np.int64)
        for p, k in number.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = k
        _, rank = np.unique([-s for s in score.values()], return_inverse=True)
        rows = [
            (number[p[:k]] << 20 | number[p[k:]], rank[number[p]], number[p])
            for p in score
            for k in range(1, len(p))
            if p[:k] in number and p[k:] in number
        ]
        self.pair_key, self.pair_rank, self.pair_made = (np.array(x, np.int64) for x in zip(*rows))
        self.sorted_at = np.argsort(self.pair_key)
        self.sorted_key = self.pair_key[self.sorted_at]
        self.merges: dict[int, tuple[int, int]] | None = None
        self.bits = 20
        slot = ((self.pair_key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.slots[slot] = np.arange(len(slot))
        self.crowded = np.bincount(slot, minlength=1 << self.bits) > 1
        self.inner = np.unique([number[p[k]] << 20 | number[p[k + 1]] for p in score for k in range(len(p) - 1)])
        joined = {c for p in score if len(p) > 1 for c in p}
        #: ASCII bytes that no merge touches: each is one token of its own
        self.alone = np.array([b < 128 and b != 0x20 and chr(b) not in joined for b in range(256)])
        names = list(score)
        whole = [p for p, n in zip(names, self.merge_counts(names).tolist()) if n == 1]
        data = [p.encode() for p in whole]
        ends = np.cumsum([len(d) for d in data])
        starts = np.concatenate([[0], ends[:-1]])
        self.whole = np.sort(span_hashes(np.frombuffer(b"".join(data), np.uint8), starts, ends))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.whole >> np.uint64(44)).astype(np.int64)] = True
        self.memory: dict[bytes, int] = {}

    def merge_counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each of many pre-tokens, all merged at the same time.

        In every round each pre-token makes the one merge that is its best, the leftmost of equal ones; the rounds
        are as many as the most merges of one pre-token. Long pre-tokens are first split where no piece has those two neighbours; parts
        that are still long are merged one by one with a heap, in the same order.
        """
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        symbol = self.char_symbol[points]
        cost = np.where(symbol < self.n_pieces, 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)
        n = len(symbol)
        if not n:
            return np.zeros(len(words), np.int64)
        key, made = self._pairs(symbol[:-1], symbol[1:])
        joint = self._adjacent(symbol) & (owner[1:] == owner[:-1])
        begin = np.flatnonzero(np.concatenate([[True], ~joint]))  # parts that no merge can join
        part = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
        key = np.append(np.where(joint, key, _NEVER), _NEVER)
        made = np.append(made, 0)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[np.append(begin[1:], n) - 1] = -1
        before[begin] = -1
        alive = np.ones(n, bool)
        place = np.arange(n)
        length = np.diff(np.append(begin, n))
        for a, size in zip(begin[length > LONG_PART].tolist(), length[length > LONG_PART].tolist()):
            cost[a] = self._merged_cost(symbol[a : a + size], cost[a : a + size], key[a : a + size])
            alive[a + 1 : a + size], key[a : a + size] = False, _NEVER
        at, first = np.arange(n), begin
        while True:
            best = np.minimum.reduceat((key[at] << 32) | place[at], first)
            chosen = best[best < _NEVER << 32] & 0xFFFFFFFF
            if not len(chosen):
                break
            gone = after[chosen]
            symbol[chosen], cost[chosen] = made[chosen], 1
            alive[gone], key[gone] = False, _NEVER
            nxt = after[gone]
            after[chosen] = nxt
            has = nxt >= 0
            before[nxt[has]] = chosen[has]
            key[chosen] = _NEVER
            key[chosen[has]], made[chosen[has]] = self._pairs(symbol[chosen[has]], symbol[nxt[has]])
            left = before[chosen]
            some = left >= 0
            key[left[some]], made[left[some]] = self._pairs(symbol[left[some]], symbol[chosen[some]])
            going = np.zeros(len(begin), bool)  # go on with the parts that just merged
            going[part[chosen]] = True
            at = at[going[part[at]] & alive[at]]
            p = part[at]
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        return np.bincount(owner[alive], weights=cost[alive], minlength=len(words)).astype(np.int64)

    def _merged_cost(self, symbol: np.ndarray, cost: np.ndarray, key: np.ndarray) -> int:
        """Tokens of one long part: best merge first, leftmost of equal ones, by a heap over linked symbols."""
        if self.merges is None:
            self.merges = dict(zip(self.pair_key.tolist(), zip(self.pair_rank.tolist(), self.pair_made.tolist())))
        merges, none = self.merges, (_NEVER, 0)
        symbols, costs, ranks = symbol.tolist(), cost.tolist(), key.tolist()
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        heap = [r << 32 | i for i, r in enumerate(ranks) if r != _NEVER]
        heapq.heapify(heap)
        while heap:
            best = heapq.heappop(heap)
            i = best & 0xFFFFFFFF
            if ranks[i] != best >> 32:  # the pair at this place has changed
                continue
            gone = after[i]
            made = symbols[i] = merges[symbols[i] << 20 | symbols[gone]][1]
            costs[i], costs[gone], ranks[gone], ranks[i] = 1, 0, _NEVER, _NEVER
            right = after[i] = after[gone]
            if right >= 0:
                before[right] = i
                rank = ranks[i] = merges.get(made << 20 | symbols[right], none)[0]
                if rank != _NEVER:
                    heapq.heappush(heap, rank << 32 | i)
            left = before[i]
            if left >= 0:
                rank = ranks[left] = merges.get(symbols[left] << 20 | made, none)[0]
                if rank != _NEVER:
                    heapq.heappush(heap, rank << 32 | left)
        return sum(costs)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each two symbols (smaller is earlier) and the symbol it makes."""
        wanted = a.astype(np.int64) << 20 | b
        slot = (wanted.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        at = self.slots[slot.astype(np.int64)]
        hit = self.pair_key[at] == wanted
        clash = np.flatnonzero(~hit & (at >= 0) & self.crowded[slot.astype(np.int64)])
        if len(clash):
            at = at.copy()
            at[clash] = np.minimum(np.searchsorted(self.sorted_key, wanted[clash]), len(self.sorted_key) - 1)
            at[clash] = self.sorted_at[at[clash]]
            hit = self.pair_key[at] == wanted
        return np.where(hit, self.pair_rank[at], _NEVER), np.where(hit, self.pair_made[at], 0)

    def _adjacent(self, symbol: np.ndarray) -> np.ndarray:
        """Whether some piece has these two characters next to each other."""
        wanted = symbol[:-1].astype(np.int64) << 20 | symbol[1:]
        at = np.minimum(np.searchsorted(self.inner, wanted), len(self.inner) - 1)
        return self.inner[at] == wanted

    def counts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each of some texts in the model's form."""
        n = len(buf)
        if not n:
            return np.zeros(len(offs) - 1, np.int64)
        start = np.zeros(n + 1, bool)
        start[offs] = True
        space, alone = buf == 0x20, self.alone[buf]
        start[1:n] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        starts = np.flatnonzero(start[:n])
        ends = np.append(starts[1:], n)
        size = np.ones(len(starts), np.int64)
        hashes = span_hashes(buf, starts, ends)
        known = alone[starts]
        maybe = np.flatnonzero(~known & self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.whole, hashes[maybe]), len(self.whole) - 1)
        known[maybe] = self.whole[at] == hashes[maybe]
        rest = np.flatnonzero(~known)
        if len(rest):
            _, one, back = np.unique(hashes[rest], return_index=True, return_inverse=True)
            raw, one = buf.tobytes(), rest[one]
            size[rest] = np.array(self._remembered([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())]), np.int64)[back]
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offs)]
        return np.diff(upto)

    def _remembered(self, words: list[bytes]) -> list[int]:
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        out = [memory.get(w) for w in words]
        new = [k for k, found in enumerate(out) if found is None]
        for k, found in zip(new, self.merge_counts([words[k].decode() for k in new]).tolist()):
            out[k] = found
            if len(words[k]) <= LONG_PART:
                memory[words[k]] = found
        return out


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def token_counts(docs: DataFrame, path: str, *, id_column: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row: ``doc_id, n_bytes, n_tokens, over_limit``. A null or empty text has no bytes and no tokens.

    The model must be a BPE model without normalization that puts a space in front of texts. ``path`` must be readable on every executor.
    """
    plain = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    form = F.when(plain == "", "").otherwise(F.concat(F.lit(" "), F.replace(plain, F.lit(MARK), F.lit(" "))))
    source = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.octet_length(plain).cast("bigint").alias("n_bytes"), form.alias("form"))

    def make():
        model = pieces(path)
        return lambda buf, offs: [model.counts(buf, offs)]

    counted = map_texts(source, "form", make, StructType.fromDDL("n_tokens bigint"), ("doc_id", "n_bytes"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
