"""Bounds that hold: hot ids and rare labels in samples, long texts in linear time, vectors at the ends of the double range, planted secrets."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from pairwright.llm import langid, lattice, piece_counts, secret_scan, toxicity  # noqa: E402

PIECES = P.path("piece_bpe_32k.model")


def test_a_hot_id_is_one_row_of_the_sample_and_rare_languages_are_in_it(spark):
    rows = [(3, f"hot text {k}", "aa") for k in range(2000)] + [(10 + k, f"text {k}", "aa") for k in range(4000)] + [(9000 + k, f"rare {k}", "oo") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)
    fit = docs.where(~langid.held_out(F.col("doc_id")))
    rare = {r.doc_id for r in fit.where("lang = 'oo'").collect()}
    for n in (1, 40, 100_000):
        seen = langid.training_windows(docs, "doc_id", "text", "lang", n, 6).collect()
        ids = [r.doc_id for r in seen]
        assert len(ids) == len(set(ids)) == min(n, fit.select("doc_id").distinct().count())  # each text is one window
        assert n == 1 or {r.doc_id for r in seen if r.lang == "oo"} == rare
    again = langid.training_windows(docs.repartition(2), "doc_id", "text", "lang", 40, 6).collect()
    assert sorted(again) == sorted(langid.training_windows(docs, "doc_id", "text", "lang", 40, 6).collect())


def test_language_sample_reads_whole_texts_within_its_bytes(spark):
    rows = [(k, f"{k:04d}" * 240, "aa" if k % 2 else "oo") for k in range(40)] + [(900, "x" * 50_000, "aa"), (901, "z" * 50_000, "zz"), (902, None, "aa"), (903, "", "oo")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, x int").repartition(4)
    text = {k: t for k, t, _ in rows}
    read = lambda size: sorted(langid.training_windows(docs, "doc_id", "text", "lang", 1000, size=size).collect())
    whole = read(1 << 20)
    fit = {r.doc_id for r in docs.where(~langid.held_out(F.col("doc_id"))).where("text <> ''").collect()}
    assert {r.doc_id for r in whole} == fit
    for k in fit:  # every byte of a text is in its windows
        assert len([r for r in whole if r.doc_id == k]) == -(-len(text[k]) // langid.WINDOW)
    few = {r.doc_id for r in read(10_000)}
    assert 0 < len(few) <= 10 and not few & {900, 901} and {k % 2 for k in few} == {0, 1}
    assert read(10) == []


def test_every_window_of_a_sampled_text_is_trained_on(monkeypatch):
    seen = []
    network = langid.Network(["a", "b"])
    keep = network.gradients
    monkeypatch.setattr(network, "gradients", lambda x, y, w: seen.extend((bytes(r), k) for r, k in zip(x, w)) or keep(x, y, w))
    counts = [1, 5, 6, 13, 400]
    text = np.repeat(np.arange(5), counts)
    x = np.zeros((len(text), langid.WINDOW), np.uint8)
    x[:, 0], x[:, 1], x[:, 2] = text + 1, np.arange(len(text)) % 251, np.arange(len(text)) // 251
    network.train(x, text % 2, text, 8)
    assert {r for r, _ in seen} == {bytes(r) for r in x}
    weight = [sum(w for r, w in seen if r[0] == t + 1) for t in range(5)]
    for of in ((0, 2, 4), (1, 3)):  # texts of a language weigh alike
        assert max(weight[t] for t in of) < 1.3 * min(weight[t] for t in of)


def test_a_hot_id_is_one_row_of_the_labelled_sample(spark):
    docs = spark.createDataFrame([(1, f"t{k}") for k in range(900)] + [(k, None if k == 7 else "x") for k in range(2, 60)], "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)] + [(1, 1), (None, 1), (3, None), (4, 7)], "doc_id bigint, toxic int")
    got = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 1000).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and set(ids) == {r.doc_id for r in labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~toxicity.held_out(F.col("doc_id"))).collect()}
    assert all(r.text == "t0" for r in got if r.doc_id == 1)
    assert toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 1).count() == 1


def library_count(text):
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text))


@pytest.mark.parametrize("make", [lambda r, n: "ab" * (n // 2), lambda r, n: "a" * n, lambda r, n: "".join(r.choice("etaoinshrdlu") for _ in range(n)), lambda r, n: "日本語é" * (n // 4)])
def test_one_long_pre_token_equals_the_library(make):
    model, rnd = piece_counts.pieces(PIECES), random.Random(8)
    for n in (piece_counts.LONG_PART - 1, piece_counts.LONG_PART + 2, 3000):
        text = make(rnd, n)
        assert model.merge_counts([" " + text, " short", " " + text[:40]]).tolist() == [library_count(t) for t in (text, "short", text[:40])]


def test_a_megabyte_without_a_space_takes_seconds():
    model, started = piece_counts.pieces(PIECES), time.process_time()
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(1_000_000))
    model.merge_counts([text])
    model.merge_counts(["ab" * 500_000])
    assert time.process_time() - started < 40  # about 4 s each; the older rounds took over an hour


def test_long_lists_of_spans_take_linear_time():
    """Ten megabytes of hex strings and keyless secrets in one text."""
    rnd = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    part = " ".join(f"deadbeef{k:012x} " + "".join(rnd.choice(letters) for _ in range(32)) for k in range(2000))
    raw = np.frombuffer(part.encode() * 100, np.uint8)
    small = secret_scan.find_spans(raw[: len(part)], np.array([0, len(part)]))
    started = time.process_time()
    found = secret_scan.find_spans(raw, np.array([0, len(raw)]))
    assert time.process_time() - started < 60
    assert 99 * len(small) <= len(found) <= 101 * len(small)


def test_spans_inside_fixed_ones_are_left_out():
    """Against every pair of spans, in several texts of one buffer."""
    rnd = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    texts = [" ".join(rnd.choice([f"token={word(30)}", word(40), f"{rnd.getrandbits(128):032x}", f"AKIA{word(20).upper()}", "plain"]) for _ in range(rnd.randrange(9))) for _ in range(60)]
    offs = np.cumsum([0, *map(len, texts)])
    found = secret_scan.find_spans(np.frombuffer("".join(texts).encode(), np.uint8), offs)
    alone = [(d, offs[d] + a, kind, offs[d] + b) for d, t in enumerate(texts) for _, a, kind, b in secret_scan.find_spans(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))]
    assert found == alone
    base = [(d, a, b) for d, a, kind, b in found if kind < 3]
    extra = [(d, a, b) for d, a, kind, b in found if kind == 3]
    assert extra and not [x for x in extra for y in base if x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2]]


@pytest.mark.parametrize(
    ("letters", "n", "least"),
    [
        ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 40, 0.99),
        ("0123456789ABCDEF", 40, 0.95),
        ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 40, 0.95),
    ],
)
def test_planted_secrets_without_a_keyword_are_found(spark, letters, n, least):
    """Recall per class on random strings in prose of the given documents, and spans where nothing was planted."""
    rnd = random.Random(12)
    prose = [r.text[:400] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").limit(150).collect()]
    hits = false = 0
    for text in prose:
        secret = "".join(rnd.choice(letters) for _ in range(n))
        at = len(text.encode()) + 1
        raw = f"{text} {secret} end".encode()
        spans = [(a, b) for _, a, kind, b in secret_scan.find_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) if kind == 3]
        hits += any(a < at + n and at < b for a, b in spans)
        false += sum(b <= at or a >= at + n for a, b in spans)
    assert hits >= least * len(prose) and not false


def test_vectors_at_the_ends_of_the_double_range(spark):
    a, b = np.array([1.0, 0.0, 0.3]), np.array([0.43, 0.9, 0.0])
    rows = [(k, (v * s).tolist()) for k, (v, s) in enumerate([(a, 1), (a, 1e-200), (a, 1e200), (b, 1e-200), (b, 1e200), (a, 1e-310), (a, 1e307), (b, 1)])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {k: (4, 0) if k in (0, 1, 2, 5, 6) else (2, 3) for k in got} and len(got) == 8
