"""Chosen-path join, lattice hashing, components and decontamination against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwright.llm import chosen_path, lattice, suffixes
from pairwright.llm.buckets import blocks, sized
from pairwright.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def grams(text, n=5):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def classes(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(9, 9), (3, 2), (2, 1), (1, 3), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = classes({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    assert got == {k: v for k, v in want.items() if k != v}


def test_every_pair_of_a_large_bucket_meets_once(spark):
    rows = spark.createDataFrame([(1, k) for k in range(50)] + [(2, k) for k in range(3)] + [(3, 99)], "bucket bigint, node bigint")
    met = {}
    for r in blocks(sized(rows), block=7).collect():
        met.setdefault((r.bucket, r.group_id), []).append((r.node, r.side))
    pairs = [(b, *sorted((x, y))) for (b, _), g in met.items() for (x, s), (y, t) in itertools.combinations(g, 2) if s == 0 or s != t]
    assert len(pairs) == len(set(pairs)) == 50 * 49 // 2 + 3
    assert max(map(len, met.values())) < 40


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(8)
    pool = [f"w{k}" for k in range(400)]
    base = [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(8, 90))) for _ in range(60)]
    docs = list(base)
    for t in base[:30]:  # copies with a few words changed
        for _ in range(3):
            w = t.split()
            for _ in range(rnd.randrange(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(pool)
            docs.append(" ".join(w))
    hot = " ".join(rnd.choice(pool) for _ in range(120)).split()
    for k in range(90):  # one large group of near copies, and of exact ones
        w = list(hot)
        w[k % 100] = f"z{k}"
        docs += [" ".join(w), " ".join(hot).upper() + "!"]
    docs += ["", "one two", "One, TWO.", "one two three", "...", base[0]]
    return docs


def test_jaccard_equals_brute_force(spark, texts):
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(9000, None, 0), (None, texts[0], 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node bigint").repartition(5)
    got = chosen_path.jaccard_classes(docs, limit=16, n_runs=32).collect()
    sets = {k: grams(t) for k, t, _ in rows if k is not None}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    count = {k: 0 for k in sets}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    root = classes(sets, links)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.class_id, r.n_links, r.kept) == (None, 0, True)
        else:
            assert (r.class_id, r.n_links, r.kept) == (root[r.doc_id], count[r.doc_id], root[r.doc_id] == r.doc_id)


def test_one_document_of_each_class_stays(spark, texts):
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(0, texts[0], "x"), (None, "one two", "x"), (None, "one two", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, class_id string")
    kept = chosen_path.one_per_class(docs, limit=16, n_runs=32)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = [r.doc_id for r in chosen_path.jaccard_classes(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), limit=16, n_runs=32).where("kept").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    """Unrelated texts under one id all stay, copies go, and the choice does not depend on partitioning."""
    rnd = np.random.default_rng(14)
    make = lambda n: " ".join(f"w{x}" for x in rnd.integers(0, 5000, n))
    a, b, c, d = (make(60) for _ in range(4))
    near = a.rsplit(" ", 1)[0] + " changed"
    rows = [(3, a, "1"), (3, b, "2"), (3, b, "3"), (3, near, "4"), (5, a, "5"), (1, c, "6"), (3, c, "7"), (9, d, "8"), (9, d, "8"), (3, "", "9"), (3, None, "10"), (None, a, "11")]
    seen = set()
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, __n__ string").repartition(parts)
        kept = sorted(map(str, (tuple(r) for r in chosen_path.one_per_class(docs).collect())))
        seen.add(tuple(kept))
    assert len(seen) == 1
    texts = [r for r in dict.fromkeys(rows) if str(r) in kept]
    by_id = sorted((k is None, k or 0, t or "") for k, t, _ in texts)
    stays = [t for k, t, _ in texts if k == 3]
    assert (a in stays) != (near in stays) and stays.count(b) == 1 and c not in stays and "" in stays and None in stays
    assert sum(k == 9 for k, _, _ in texts) == 1 and sum(k == 5 for k, _, _ in texts) == 0 and (True, 0, a) in by_id and (False, 1, c) in by_id
    assert len(texts) == 7


def test_coordinates_throw_away_no_pair_at_the_threshold():
    n, least = chosen_path.COORDINATES, chosen_path.least_alike(0.8)
    assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least)) <= 1e-7
    assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least + 1)) > 1e-7


def test_recall_on_a_large_group_of_near_copies(spark):
    """1,200 different texts around the threshold, with the number of runs and the limit that queries use."""
    rnd = np.random.default_rng(8)
    n_words, n_texts = 904, 1200
    base = [f"w{k}" for k in range(n_words)]
    rows, same = [], np.ones((n_texts, n_words - 4), np.int32)
    for d in range(n_texts):
        text = list(base)
        for at in rnd.choice(n_words, rnd.integers(8, 12), replace=False):
            text[at] = f"x{d}y{at}"  # a word of its own
            same[d, max(0, at - 4) : at + 1] = 0
        rows.append((d, " ".join(text)))
    both = same @ same.T
    linked = both >= 0.8 * (2 * (n_words - 4) - both) - 1e-9
    want = linked.sum(axis=1) - 1
    got = np.zeros(n_texts, np.int64)
    for r in chosen_path.jaccard_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect():
        got[r.doc_id] = r.n_links
    print("pairs", want.sum() // 2, "missed", (want - got).sum() // 2)
    assert 200_000 < want.sum() // 2 < 700_000 and (got <= want).all()
    assert (want - got).sum() <= 1e-3 * want.sum()


def test_jaccard_of_no_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert chosen_path.jaccard_classes(none).count() == 0 and chosen_path.one_per_class(none).count() == 0


def test_lattice_points_are_nearest():
    x = np.random.default_rng(2).normal(0, 1, (200, 8))
    point = lattice.decode(x)
    for p, v in zip(point, x):
        assert ((v - p) ** 2).sum() <= ((v - p - lattice.NEIGHBOURS) ** 2).sum(axis=1).min() + 1e-9
        doubled = np.rint(2 * p).astype(int)
        assert len(set(doubled % 2)) == 1 and p.sum() % 2 == 0
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(axis=1), 2)


def test_lattice_hashing_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(80, 32))
    near = [b + rng.normal(size=32) * s for b in base[:25] for s in (0.02, 0.1, 0.2)]
    hot = [base[0] + rng.normal(size=32) * 0.05 for _ in range(300)]
    vectors = [v.tolist() for v in (*base, *near, *hot)] + [base[3].tolist()] * 4
    odd = [None, [], [0.0] * 32, [1.0] * 31 + [None], [1.0] * 31 + [float("nan")], [float("inf")] * 32, [1.0, 2.0], [2.0, 4.0]]
    rows = [(k, v, 1) for k, v in enumerate(vectors + odd)]
    table = spark.createDataFrame([*rows, (None, vectors[0], 1)], "vec_id bigint, embedding array<double>, copies int").repartition(4)
    got = {r.vec_id: r for r in lattice.near_duplicates(table).collect()}
    n = len(vectors)
    unit = np.array(vectors)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.95, 1)))] + [(n + 6, n + 7)]
    root = classes(range(n + len(odd)), links)
    count = np.bincount(np.array(links).ravel(), minlength=n + len(odd))
    assert len(got) == len(rows) + 1
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    wrong = [k for k in root if (got[k].n_links, got[k].component_id) != (count[k], root[k])]
    assert not wrong


def test_lattice_recall_near_the_threshold():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g = rng.normal(size=a.shape)
    g -= (g * a).sum(axis=1, keepdims=True) * a
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    shape = (lattice.TABLES, lattice.BLOCKS, lattice.PROBES, lattice.SCALE)
    one, two = lattice.cells(a, *shape), lattice.cells(0.951 * a + np.sqrt(1 - 0.951**2) * g, *shape)
    assert (one[:, :, None] == two[:, None, :]).any(axis=(1, 2)).mean() > 0.99


def test_lattice_of_no_vectors(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def hits(docs, items, window):
    known = {}
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            known.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in known}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in known:
                    hit.update(range(a, a + k))
                    found |= known[tuple(w[a : a + k])]
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rnd = random.Random(4)
    pool = [f"w{k}" for k in range(60)]
    line = lambda n: " ".join(rnd.choice(pool) for _ in range(n))
    items = [(k, line(rnd.randrange(10, 40))) for k in range(20)] + [(20, "Rare short item"), (21, ""), (22, None), (None, "w1 w2"), (10, line(12)), (3, line(30))]
    docs = [(k, line(rnd.randrange(0, 60))) for k in range(60)]
    docs += [(100, items[0][1]), (101, "x " + items[1][1][:-3] + " " + items[2][1].upper()), (102, "rare, SHORT? item rare short"), (103, None), (104, ""), (100, items[5][1] * 2)]
    docs += [(105, (items[4][1] + " ") * 400)]
    table = spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id bigint, text string, matches string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = suffixes.benchmark_matches(table, bench, block_bytes=block_bytes)
    got = found.select("doc_id", "n_words", suffixes.hit_words(F.col("matches")), F.array_join(suffixes.item_ids(F.col("matches")), ",")).collect()
    real = [(i, t) for i, t in items if i is not None and t is not None]
    assert sorted(map(tuple, got)) == sorted(hits(docs, real, 10))


def test_matches_are_longest_and_in_place(spark):
    item = "a b c d e f g h i j k l m n o p"
    docs = spark.createDataFrame([(1, "x y " + item[4:] + " z")], "doc_id bigint, text string")
    r = suffixes.benchmark_matches(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).first()
    assert [tuple(m) for m in r.matches] == [("7", 2, 2, 14)]


def test_contaminated_documents_go(spark):
    item = " ".join(f"t{k}" for k in range(12))
    docs = spark.createDataFrame([(1, item, 5), (2, "clean text", 6), (3, None, 7), (2, "clean text", 6)], "doc_id bigint, text string, n_words int")
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    left = suffixes.without_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 2, 3]
    assert suffixes.without_contaminated(docs, bench.limit(0)).count() == 4
    assert suffixes.without_contaminated(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_items_without_an_id_are_hits(spark, block_bytes):
    text = " ".join(f"w{k}" for k in range(40))
    items = [(None, text)] + [(f"i{k}", " ".join(f"v{k}x{j}" for j in range(30))) for k in range(9)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, f"a b {text} c"), (2, f"b {items[3][1]}"), (3, "plain"), (None, text), (4, None)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in suffixes.benchmark_matches(docs, bench, block_bytes=block_bytes).collect()}
    assert [tuple(m) for m in found[1].matches] == [(None, 0, 2, 40)] and [m.item_id for m in found[2].matches] == ["i2"]
    assert len(found) == 5 and found[3].matches == found[4].matches == [] and found[4].n_words == 0 and len(found[None].matches) == 1
    left = suffixes.without_contaminated(docs, bench, block_bytes=block_bytes)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4]


def test_one_block_of_the_benchmark_at_a_time(spark, monkeypatch):
    bench = spark.createDataFrame([(f"i{k}", " ".join(f"v{k}x{j}" for j in range(30))) for k in range(20)], "item_id string, text string")
    n, blocks = suffixes.benchmark_blocks(bench, "item_id", "text", 500)
    events = []

    def told():
        for block in blocks:
            events.append("block")
            yield block

    keep = suffixes.written
    monkeypatch.setattr(suffixes, "benchmark_blocks", lambda *rest: (n, told()))
    monkeypatch.setattr(suffixes, "written", lambda *rest: events.append("written") or keep(*rest))
    suffixes.benchmark_matches(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), bench, block_bytes=500)
    assert n > 3 and events == ["block", "written"] * n


def longest_matches(doc, items, window):
    w, out = words(doc), []
    for name, text in items:
        v = words(text)
        need = min(window, len(v))
        for a in range(len(v)):
            for b in range(len(w)):
                if need and not (a and b and v[a - 1] == w[b - 1]):
                    n = 0
                    while a + n < len(v) and b + n < len(w) and v[a + n] == w[b + n]:
                        n += 1
                    if n >= need:
                        out.append((name, a, b, n))
    return sorted(out)


@pytest.mark.parametrize("step", [1, 40, 1 << 20])
def test_matches_and_their_order_do_not_depend_on_blocks(spark, monkeypatch, step):
    rnd = random.Random(8)
    line = lambda n: " ".join(f"w{rnd.randrange(4)}" for _ in range(n))
    items = [(f"i{k}", line(rnd.randrange(3, 40))) for k in range(9)] + [("z", "a b " * 15), ("a", "b a " * 12), ("one", "single")]
    docs = [(k, line(90)) for k in range(12)] + [(50, "a b " * 60), (51, items[4][1] + " x " + items[2][1]), (52, "single b a single")]
    # one number of occurrences a look, and many
    probe = suffixes.Probe(items, 10)
    monkeypatch.setattr(suffixes, "STEP", step)
    for doc, text in docs:
        for _, _, buf, offs in suffixes.chunks(pa.array([text])):
            _, place, q, size = suffixes.shard_matches(probe, *suffixes.word_hashes(buf, offs))
            got = sorted((probe.names[probe.item[i]], int(probe.start[i]), int(p), int(n)) for i, p, n in zip(q, place, size))
            assert got == longest_matches(text, items, 10), doc
    if step > 1:
        return
    table, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    for block_bytes in (1 << 20, 150):
        for r in suffixes.benchmark_matches(table, bench, block_bytes=block_bytes).collect():
            assert [tuple(m) for m in r.matches] == longest_matches(dict(docs)[r.doc_id], items, 10)
