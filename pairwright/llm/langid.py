"""Language identification by a byte convolutional network, trained in numpy.

A text is read through windows of a fixed number of bytes, without gaps, to its end. In a window, filters of several widths run over the
bytes, each filter keeps its largest response, and a softmax layer gives a probability per language. Narrow windows see one
word or two, so the probabilities of a text's windows are averaged. The network is small: byte vectors, one filter bank per width and the
output layer. For prediction the bank is folded into tables over pairs of bytes, so a window costs look-ups and additions.

Training reads all windows of at most ``sample_rows`` labelled texts with at most ``sample_bytes`` together; texts of many windows deal
them over the epochs, so every window is read at least once and no text outweighs another. Prediction reads every byte of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.llm.bpe import LETTER, byte_classes
from pairwright.llm.store import written
from pairwright.llm.texts import map_texts, per_text

WIDTHS = (2, 3, 4)
FILTERS = 8
BYTE_DIMS = 8
WINDOW = 96
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 32 << 20
#: Windows of a text in one epoch, at least where it has as many; more where the epochs would not reach all of them.
TURN = 6
EPOCHS = 8
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
#: Windows scored together.
STEP = 512


def held_out(id_column: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == fold, F.lit(False))


def windows(buf: np.ndarray, offs: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some texts as rows of bytes, and how many each text has; the last one of a text is filled with zeros."""
    lengths = np.diff(offs)
    counts = -(-lengths // size)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.repeat(offs[:-1], counts) + size * (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts))
    place = at[:, None] + np.arange(size)[None, :]
    inside = place < offs[1:][doc][:, None]
    return np.where(inside, buf[np.minimum(place, max(len(buf) - 1, 0))] if len(buf) else 0, 0).astype(np.uint8), counts


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.byte = rng.normal(0, 0.3, (256, BYTE_DIMS)).astype(np.float32)
        self.banks = [rng.normal(0, 0.3, (w, BYTE_DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.shift = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.byte, *self.banks, self.bias, self.out, self.shift]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted log loss over a batch of windows."""
        n = len(x)
        vectors = self.byte[x]
        pooled, where = [], []
        for w, bank in zip(WIDTHS, self.banks):
            span = x.shape[1] - w + 1
            response = sum(vectors[:, k : k + span] @ bank[k] for k in range(w))
            top = response.argmax(axis=1)
            where.append(top)
            pooled.append(np.take_along_axis(response, top[:, None, :], 1)[:, 0])
        raw = np.hstack(pooled) + self.bias
        hidden = np.maximum(raw, 0)
        logit = hidden @ self.out + self.shift
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        delta = p
        delta[np.arange(n), y] -= 1
        delta *= (weight / weight.sum())[:, None]
        back = (delta @ self.out.T) * (raw > 0)
        d_byte, d_banks = np.zeros_like(self.byte), []
        rows = np.repeat(np.arange(n), FILTERS)
        for b, (w, bank) in enumerate(zip(WIDTHS, self.banks)):
            g = back[:, b * FILTERS : (b + 1) * FILTERS].reshape(-1)
            top, f = where[b].reshape(-1), np.tile(np.arange(FILTERS), n)
            d_bank = np.zeros_like(bank)
            for k in range(w):
                byte = x[rows, top + k]
                seen = self.byte[byte] * g[:, None]
                for j in range(FILTERS):
                    d_bank[k, :, j] = seen[f == j].sum(axis=0)
                np.add.at(d_byte, byte, bank[k].T[f] * g[:, None])
            d_banks.append(d_bank)
        return [d_byte, *d_banks, back.sum(axis=0), hidden.T @ delta, delta.sum(axis=0)]

    def train(self, x: np.ndarray, y: np.ndarray, text: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.01, seed: int = 3) -> None:
        """Adam. Windows of one ``text`` (numbers from 0, ascending) take turns, so that all are read once in the epochs; every language
        has the same weight in total, and so has every text of a language."""
        count = np.bincount(text)
        first = np.cumsum(count) - count
        turns = np.clip(count // TURN, 1, max(epochs, 1))[text]
        turn = (np.arange(len(x)) - first[text]) % turns
        texts = np.bincount(y[first], minlength=len(self.languages))
        share = turns / count[text] / texts[y]
        rng = np.random.default_rng(seed)
        means = [np.zeros_like(p) for p in self.parameters()]
        squares = [np.zeros_like(p) for p in self.parameters()]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(np.flatnonzero(turn == epoch % turns))
            pace = rate * (1 - epoch / epochs)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                step += 1
                for p, g, m, v in zip(self.parameters(), self.gradients(x[some], y[some], share[some]), means, squares):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
        self.fold()

    def fold(self) -> None:
        """Responses of all filters to every pair of bytes: the pair at a place, and what wider filters add from the next places."""
        one = [[self.byte @ bank[k] for k in range(w)] for w, bank in zip(WIDTHS, self.banks)]
        pair = lambda a, b: (a[:, None] + b[None, :]).reshape(65536, FILTERS)
        self.near = np.hstack([pair(one[0][0], one[0][1]), pair(one[1][0], one[1][1]), pair(one[2][0], one[2][1])])
        third = np.repeat(one[1][2], 256, axis=0)  # the third byte alone
        self.far = np.hstack([third, pair(one[2][2], one[2][3])])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A row of probabilities per window."""
        n, size = x.shape
        code = x.astype(np.int32) << 8
        code[:, :-1] |= x[:, 1:]  # the last place has no second byte; only filters that need none look at it
        out = np.empty((n, len(self.languages)), np.float32)
        for at in range(0, n, STEP):
            c = code[at : at + STEP]
            near, far = self.near[c[:, :-1]], self.far[c[:, 2:]]
            pooled = np.concatenate(
                [
                    near[:, :, :FILTERS].max(axis=1),
                    (near[:, : size - 2, FILTERS : 2 * FILTERS] + far[:, :, :FILTERS]).max(axis=1),
                    (near[:, : size - 3, 2 * FILTERS :] + far[:, : size - 3, FILTERS:]).max(axis=1),
                ],
                axis=1,
            )
            logit = np.maximum(pooled + self.bias, 0) @ self.out + self.shift
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            out[at : at + STEP] = p / p.sum(axis=1, keepdims=True)
        return out

    def predict(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities of each text, and whether it has a letter."""
        x, counts = windows(buf, offs)
        mean = np.zeros((len(counts), len(self.languages)))
        some = np.flatnonzero(counts)
        if len(some):
            begin = (np.cumsum(counts) - counts)[some]
            mean[some] = np.add.reduceat(self.probabilities(x).astype(np.float64), begin, axis=0) / counts[some, None]
        letters = per_text(byte_classes(buf) == LETTER, offs) > 0
        return mean, letters


def training_windows(
    docs: DataFrame, id_column: str, text: str, label: str, rows: int, per_row: int | None = None, size: int = SAMPLE_BYTES
) -> DataFrame:
    """Windows of at most ``rows`` labelled texts outside the held-out fold, of ``size`` bytes together: ``(doc_id, lang, x)``, all windows
    of a text or ``per_row`` of them, evenly apart.

    Labels take turns, each in the order of a hash of the id, so a rare language is learned from as many rows as a common one while it
    has them. An id counts once, with the smallest of its labels and texts, however many rows repeat it. A text of more than ``size``
    bytes is not used; null and empty texts have no window. Extra columns are not read.
    """
    key, lang = F.col(f"`{id_column}`"), F.col(f"`{label}`")
    fit = docs.where(key.isNotNull() & lang.isNotNull() & ~held_out(key))
    ids = fit.groupBy(key.alias("k")).agg(F.min(lang).alias("l")).withColumn("draw", F.xxhash64("k"))
    turn = F.row_number().over(Window.partitionBy("l").orderBy("draw", "k"))
    chosen = ids.withColumn("turn", turn).where(F.col("turn") <= rows).orderBy("turn", "draw", "k").limit(rows)
    inner = fit.select(key.alias("doc_id"), lang.alias("lang"), F.col(f"`{text}`").alias("text"), F.octet_length(f"`{text}`").alias("n"))
    inner = inner.where(F.coalesce("n", F.lit(0)) <= size)
    inner = inner.join(F.broadcast(chosen), (F.col("doc_id") == F.col("k")) & (F.col("lang") == F.col("l")))  # bounded by ``rows``
    inner = inner.groupBy("doc_id", "lang", "turn", "draw").agg(F.min("text").alias("text"))
    inner = written(inner, "lang-sample")
    before = F.sum(F.octet_length("text")).over(Window.orderBy("turn", "draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    some = inner.withColumn("sum", before).where(F.coalesce("sum", F.lit(0)) <= size).select(F.col("doc_id").alias("k"), F.col("lang").alias("l"))
    inner = inner.join(F.broadcast(some), (F.col("doc_id") == F.col("k")) & (F.col("lang") == F.col("l")))  # bounded by ``rows``

    def make():
        def compute(buf, offs):
            x, counts = windows(buf, offs)
            ends, out = np.cumsum(counts), []
            for end, n in zip(ends.tolist(), counts.tolist()):
                pick = range(end - n, end) if per_row is None else np.unique(np.linspace(end - n, end - 1, min(n, per_row)).astype(int)) if n else []
                out.append([x[k].tobytes() for k in pick])
            return [pa.array(out, pa.list_(pa.binary()))]

        return compute

    made = map_texts(inner, "text", make, StructType.fromDDL("x array<binary>"), ("doc_id", "lang"))
    return made.select("doc_id", "lang", F.explode("x").alias("x"))


def fit(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
    epochs: int = EPOCHS,
) -> Network:
    """Train on all windows of at most ``sample_rows`` labelled texts of ``sample_bytes`` together; which ones tells
    :func:`training_windows`. Without any, every text is ``und``. The result depends on neither partitioning nor the order of rows."""
    rows = training_windows(docs, id_column, text, label, sample_rows, size=sample_bytes).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["x"])))
    languages = sorted({r["lang"] for r in rows})
    network = Network(languages)
    if rows:
        number = {name: k for k, name in enumerate(languages)}
        x = np.stack([np.frombuffer(bytes(r["x"]), np.uint8) for r in rows])
        new = [a["doc_id"] != b["doc_id"] for a, b in zip(rows[1:], rows)]
        network.train(x, np.array([number[r["lang"]] for r in rows]), np.cumsum([0, *new]), epochs)
    return network


def identified(docs: DataFrame, network: Network, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``doc_id, lang_pred, score``; ``und`` with score 0 where the text is null or has no letter.

    Repeated rows get the same answer; of equal probabilities the first language by name is taken; a very long text is read to its end in
    windows. Extra columns, also ones named like a result column, are not read.
    """
    inner = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def make():
        def compute(buf, offs):
            n = len(offs) - 1
            if not network.languages:
                return [[UNKNOWN] * n, np.zeros(n)]
            mean, letters = network.predict(buf, offs)
            best = mean.argmax(axis=1)
            names = [network.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist())]
            return [names, np.where(letters, np.minimum(mean.max(axis=1), 1.0), 0.0)]

        return compute

    return map_texts(inner, "text", make, StructType.fromDDL("lang_pred string, score double"), ("doc_id",))
