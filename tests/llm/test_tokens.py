"""BPE and token counts equal the libraries; words equal their pattern."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from pairwright.llm import bpe, piece_counts, texts  # noqa: E402

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
HARD = [
    "", " ", "a", "it's we'll I'VE 'sing '' 's !'s 'll", "  two  spaces \n\n\n tabs\t\tend ", "x<|endoftext|> y <|endoftext|>", "a" * 5000, "ab " * 700,
    "日本語 und Größe ½²³ 　 wide space", "😀👩‍👩‍👧 é", "\x00\x01​", "▁mark ▁▁ <s></s>", " " * 400, "\r\n" * 50, "!" * 300, "naïve-coöperate_1234567890",
]


def fuzz(n):
    rnd = random.Random(3)
    parts = list("aabcstdrevlm'' \n\t.!0129éßÑ½²") + [" "] * 6 + ["'s", "'ll", "'re", "<|endoftext|>", " ", "　", "日本", "😀", "▁", "\r\n", "<s>", "\x00", "'S"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 70))) for _ in range(n)]


def test_words_equal_the_pattern():
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    samples = HARD + fuzz(300) + ["Ab aB", "", "x"]
    for limit in (1, 50, 1 << 20):
        found = []
        for _, _, buf, offs in texts.chunks(pa.array(samples), limit):
            hashes, first = texts.word_hashes(buf, offs)
            found += [hashes[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        names = {}
        for text, got in zip(samples, found):
            words = pattern.findall("".join(c.lower() if c.isascii() else c for c in text))
            assert len(words) == len(got)
            for w, h in zip(words, got):
                assert names.setdefault(w, h) == h
        assert len(set(names.values())) == len(names)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    samples = HARD + fuzz(500)
    rows = [(k, t, 1) for k, t in enumerate(samples)] + [(-1, None, 1), (0, samples[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")  # a column named like a result
    coded = bpe.encode(docs, BPE, decoded="back").collect()
    assert len(coded) == len(rows)
    for r in coded:
        text = samples[r.doc_id] if r.doc_id >= 0 else ""
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.back == library.decode(want, skip_special_tokens=False) == text


def test_decoding_a_column_of_ids(spark):
    raw = np.array([0, 255, 50256], "<u4").tobytes()
    rows = spark.createDataFrame([(1, bytearray(raw)), (2, None), (3, bytearray())], "k int, ids binary")
    table = bpe.offset_table(BPE)
    got = {r.k: r.decoded for r in bpe.decode(rows, BPE).collect()}
    assert got[1] == table.decode(np.array([0, 255, 50256])).tobytes().decode("utf-8", "replace") and got[2] == got[3] == ""


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(none, BPE).count() == 0 and piece_counts.token_counts(none, PIECES).count() == 0


def test_pairs_are_compatible_exactly_when_merging_keeps_them():
    words = bpe.vocabulary(BPE)

    words_parts = {v: k for k, v in words.parts.items()}
    rnd = random.Random(1)

    def plain(a, b):
        parts = [words.tokens.index(bytes([c])) for c in words.tokens[a] + words.tokens[b]]
        while True:
            ranks = [(words.rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in words.rank]
            if not ranks:
                return parts
            _, k = min(ranks)
            parts[k : k + 2] = [words_parts[parts[k], parts[k + 1]]]

    for _ in range(1500):
        a, b = rnd.randrange(3000), rnd.randrange(3000)
        assert words.compatible(a, b) == (plain(a, b) == [a, b])


def test_counts_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    samples = HARD + fuzz(500) + ["x" * 4097 + " y"]
    rows = [(k, t) for k, t in enumerate(samples)] + [(None, None)]
    got = piece_counts.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), PIECES, limit=50).collect()
    assert len(got) == len(rows)
    for r in got:
        text = samples[r.doc_id] if r.doc_id is not None else ""
        n = len(library.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 50)


def test_whole_token_proofs_hold():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = piece_counts.pieces(PIECES)
    for text in ("the", "hello", "zu"):
        h = texts.span_hashes(np.frombuffer((" " + text).encode(), np.uint8), np.array([0]), np.array([len(text) + 1]))[0]
        assert (h in model.whole) == (len(library.encode(text)) == 1)


def test_digest_of_ids_is_little_endian(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id bigint, text string")
    r = bpe.encode(docs, BPE).first()
    ids = np.frombuffer(bytes(r.ids), "<u4")
    assert hashlib.sha256(bytes(r.ids)).hexdigest() == hashlib.sha256(b"".join(int(i).to_bytes(4, "little") for i in ids)).hexdigest()
