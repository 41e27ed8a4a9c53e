"""Prefix trie, id files and collocations against brute force and the tokenizers library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairwright.llm import id_files, phrases, prefix_trie
from pairwright.llm.queries import QUERIES
from pairwright.session import new_path

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- prefix trie


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(rows):
    """Nodes of ``{conv_id: [(role, text), ..]}`` by nested dictionaries."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(rows):
        for d in range(len(rows[c]) + 1):
            members[tuple(rows[c][:d])].append(c)
        ends[tuple(rows[c])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    saved = Counter()
    leaves = Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
            leaves[p[:d]] += not kids[p]
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, ends[p])))) for p, m in members.items()
    )


def rebuilt(turns):
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, [])[:h] + turns[c][h:]
    return out


def shown(nodes, ends):
    found = nodes.join(prefix_trie.ends_digests(ends), "node", "left").withColumn("e", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "e")
    return sorted(tuple(r[n] for n in names) for r in found.collect())


def talks(seed=3):
    rng = random.Random(seed)
    texts = ["", "a", "b c", "a\tb\nc  d", "é ü", "x" * 30_000]
    turns = {c: [(rng.choice(["user", "assistant", ""]), rng.choice(texts)) for _ in range(rng.choice([1, 1, 2, 3, 5]))] for c in rng.sample(range(400), 200)}
    same = [("user", "hello there"), ("assistant", "one two three")]
    turns |= {c: same for c in range(1000, 1150)}  # a third and more of all rows
    turns[2000] = [("user", str(k)) for k in range(150)]
    turns |= {c: turns[2000][:] for c in range(2020, 2100, 20)}  # equal ones longer than a splitter
    return turns


def frame(spark, turns, extra=()):
    rows = [(c, k, r, t) for c, x in turns.items() for k, (r, t) in enumerate(x)] + list(extra)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_trie_equals_nested_dictionaries(spark, shards):
    turns = talks()
    made = prefix_trie.rebuilt(prefix_trie.paths(frame(spark, turns).repartition(5)))
    assert shown(*prefix_trie.trie(made, shards)) == plain_trie(rebuilt(turns))


def test_trie_spreads_equal_conversations(spark):
    turns = {c: [("user", "same")] for c in range(3000)}
    table = prefix_trie.paths(frame(spark, turns))
    cuts = prefix_trie.splitters(table, 8, 3000)
    assert len(cuts) == 7 and len({c for _, c in cuts}) == 7
    nodes, ends = prefix_trie.trie(table, 8)
    parts = [r["n"] for r in ends.groupBy("part").agg(F.sum(F.size("ids")).alias("n")).collect()]
    assert len(parts) == 8 and max(parts) < 3000 / 3
    assert shown(nodes, ends) == plain_trie(turns)


def test_trie_of_odd_rows(spark):
    rows = [(4, None, None, None), (4, 1, "user", "b"), (4, 1, "user", "b"), (None, 0, "user", "lost"), (5, 0, "user", "x"), (6, 0, "user", "x"), (6, 0, "bot", "y")]
    table = frame(spark, {}, rows).withColumn("path", F.lit("clash")).withColumn("words", F.lit(1)).withColumn("t", F.lit(0))
    want = {4: [("", ""), ("user", "b"), ("user", "b")], 5: [("user", "x")], 6: [("bot", "y"), ("user", "x")]}
    assert shown(*prefix_trie.trie(prefix_trie.paths(table))) == plain_trie(want)
    assert shown(*prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(table)))) == plain_trie(rebuilt(want))


def test_trie_of_no_rows_and_of_turnless_conversations(spark):
    empty = frame(spark, {}, [(1, 0, "u", "t")]).limit(0)
    nodes, ends = prefix_trie.trie(prefix_trie.paths(empty))
    assert nodes.count() == 0 and prefix_trie.ends_digests(ends).count() == 0
    short = {c: [("user", "gone")] for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4}  # no conversation 20
    assert shown(*prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(frame(spark, short))), 3)) == plain_trie({c: [] for c in short})


def test_lists_of_ends_come_in_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_TOGETHER", 10)
    walk = prefix_trie._Walk(0)
    for c in range(95):
        walk.add(c, b"k" * 16, [1], 0)
    walk.finish()
    lists = [r[12] for r in walk.out if r[0] == "ends"]
    assert [x for y in lists for x in y] == list(range(95)) and max(map(len, lists)) == 10


# ---------------------------------------------------------------- id files


def hard_texts():
    rng = random.Random(5)
    odd = ["it's", "IT'S", "a.b", "...", "?!'s", "é", "́x", "<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|>", "1234", "3.14", "naïve", "東京", " ", " ", "#", "🙂", "ﬁ", "İ", "ΑΣ", "a;", ".̸", "l'été", "O'Re"]
    texts = [" ".join(rng.choice(odd) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    texts += ["".join(rng.choice(odd + [" ", "\n", "\t"]) for _ in range(30)) for _ in range(200)]
    return texts + ["", " ", "word " * 50_000, "ab" * 3_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def test_words_equal_the_library(spark, library):
    texts = hard_texts()
    docs = spark.createDataFrame([*enumerate(texts), (9999, None), (None, "a"), (3, "again")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = [(r.doc_id, np.frombuffer(bytes(r.ids), "<u2").tolist()) for r in id_files.tokens(docs.repartition(3), WORDS, end=2).collect()]
    want = [(k, library.encode(t or "", add_special_tokens=False).ids + [2]) for k, t in [*enumerate(texts), (9999, None), (None, "a"), (3, "again")]]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(id_files, "REMEMBERED", 40)
    words = id_files.WordEncoder(WORDS)
    for text in hard_texts()[:100]:
        raw = np.frombuffer(text.encode(), np.uint8)
        assert words.encode(raw, np.array([0, len(raw)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_codes_of_every_length_round_trip():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 2, 3, 4, 5, 0, 1000, 7])
    ranks = np.concatenate([rng.integers(0, 1 << b, n) for b, n in zip((1, 8, 9, 16, 17, 24, 1, 32, 32), counts)])
    control, controls, data, sizes = id_files.coded(ranks, counts)
    assert len(control) == controls.sum() == sum(-(-c // 4) for c in counts) and len(data) == sizes.sum()
    assert (id_files.ranks_of(control, data, counts) == ranks).all()
    assert id_files.coded(np.array([255, 256, 65535, 65536]), np.array([4]))[3].tolist() == [1 + 2 + 2 + 3]


def stored(spark, rows, width=2, shards=None):
    table = spark.createDataFrame([(k, np.array(x, f"<u{width}").tobytes()) for k, x in rows], "doc_id bigint, ids binary")
    path = id_files.write_ids(table, new_path(spark, "test-ids"), width, shards)
    found = id_files.read_ids(spark, path).orderBy("start", "n_tokens").collect()
    return path, [(r.doc_id, r.start, r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in found]


def test_files_hold_documents_in_order_and_frequent_ids_in_a_byte(spark):
    rng = random.Random(2)
    rows = [(k, [min(int(rng.expovariate(0.01)), 65_000) for _ in range(rng.randint(0, 40))]) for k in range(500)]
    path, got = stored(spark, random.Random(3).sample(rows, 500), shards=6)
    assert [(k, x) for k, _, _, x in got if x] == [(k, x) for k, x in rows if x]
    assert all(s == sum(len(x) for _, x in rows[:k]) for k, s, _, _ in got)
    freq = Counter(x for _, ids in rows for x in ids)
    ranks = {r["id"]: r["rank"] for r in spark.read.parquet(f"{path}/ranks").collect()}
    assert [k for k, _ in sorted(ranks.items(), key=lambda p: p[1])] == sorted(freq, key=lambda k: (-freq[k], k))
    shards = spark.read.parquet(f"{path}/shards").groupBy("shard").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("shard").collect()
    assert len(shards) == 6 and all(x["b"] < y["a"] for x, y in zip(shards, shards[1:]))


def test_files_of_repeated_null_and_wide_ids(spark):
    rows = [(7, [1, 2, 3])] * 300 + [(7, [4])] * 5 + [(None, [9]), (None, []), (-3, [1 << 31, 70_000, 5])]
    _, got = stored(spark, rows, width=4, shards=8)
    assert [k for k, _, n, _ in got if n] == [None, -3] + [7] * 305
    assert sorted(map(str, ((k, x) for k, _, _, x in got))) == sorted(map(str, rows))
    assert [s for _, s, _, _ in got] == sorted(s for _, s, _, _ in got) and got[-1][1] + got[-1][2] == sum(len(x) for _, x in rows)
    shards = spark.read.parquet(f"{stored(spark, rows, 4, 8)[0]}/shards").groupBy("shard").count()
    assert shards.agg(F.max("count")).first()[0] < 150  # one id on nearly all rows is spread
    assert stored(spark, [])[1] == []
    assert sorted(stored(spark, [(1, []), (2, [])])[1]) == [(1, 0, 0, []), (2, 0, 0, [])]


def test_id_files_query_equals_the_library(spark, library):
    want, start = [], 0
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op12_id_files"](spark, SF).collect()) == want


# ---------------------------------------------------------------- collocations


def plain_collocations(rows, threshold, max_words=5, percent=100, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {p: n for p, n in f.items() if n >= threshold}
    inner = Counter()
    for (lang, p), n in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inner[lang, p[i : i + k]] = max(inner[lang, p[i : i + k]], n)
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if len(p) > 1 and not (inner[lang, p] and 100 * inner[lang, p] >= percent * a):
            score, k = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], total[lang]))
    return sorted((lang, i, p.decode(), -a, le, r, n, -s) for lang, x in out.items() for i, (s, a, p, le, r, n) in enumerate(sorted(x)[:top], 1))


def test_summary_keeps_all_frequent_keys():
    rng = np.random.default_rng(4)
    keys = np.concatenate([rng.integers(0, 5000, 40_000), np.repeat(np.arange(10), 300)]).astype(np.uint64)
    rng.shuffle(keys)
    threshold = 250
    summary = phrases.Summary(len(keys) // threshold + 1)
    for part in np.array_split(keys, 37):
        summary.merge(*phrases._summed(part, np.ones(len(part), np.int64)))
        assert len(summary.keys) <= summary.capacity
    true = Counter(keys.tolist())
    assert summary.lost < threshold
    held = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
    assert all(n - summary.lost <= held.get(k, 0) <= n for k, n in true.items())
    assert {k for k, n in true.items() if n >= threshold} <= set(summary.survivors(threshold).tolist())


def prose(seed=6, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["New", "new", "York", "été", "C++"]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\n", "\t "]) for _ in range(rng.randint(0, 60))]
        rows.append((" ".join(words) + rng.choice(["", " in the state of New York", " To be, or not to be"]), rng.choice(["en", "en", "fr", None])))
    return rows + [(None, "en"), ("", None), ("a a a a a a a a", "de"), ("only: one; word!", "xx"), ("und so", "und")]


@pytest.mark.parametrize("options", [{}, {"filter_bits": 8}, {"max_words": 3, "percent": 60}, {"top": 7, "parts": 3}])
def test_collocations_equal_brute_force(spark, options):
    rows = prose()
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in phrases.collocations(docs.repartition(6), threshold=4, **options).collect())
    plain = {k: v for k, v in options.items() if k in ("max_words", "percent", "top")}
    assert len(got) > 20 and got == plain_collocations(rows, 4, **plain)


def test_collocations_of_a_long_repeated_text_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(phrases, "GATHERED", 1000)  # tasks pass sums on many times
    rows = [("x y z " * 20_000, "en")] + [("p q. r s", "en")] * 150 + [("p q", "fr")] * 99
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = sorted(tuple(r) for r in phrases.collocations(docs).collect())
    assert got == plain_collocations(rows, 100) and {r[0] for r in got} == {"en"}
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs, max_words=1).count() == 0


def test_products_past_64_bits_are_exact(spark):
    counts = spark.createDataFrame([("x", 3_000_000_000_000, 9_000_000_000_000_000)], "p string, a bigint, n bigint")
    long = lambda c: F.col(c).cast("decimal(19,0)")
    found = counts.select(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * long("a") * long("n"), long("a") * F.lit(7).cast("decimal(19,0)")).alias("s")).first()["s"]
    assert found == 1000 * 9_000_000_000_000_000 // 7
