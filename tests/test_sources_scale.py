"""Csv in byte ranges, versions of tables, resumable scoring, vocabularies: small cases checked by hand."""

import csv
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pairwright.operators import scoring, vocabulary
from pairwright.sources import csv_ranges, readers, snapshots

SCHEMA = "id long, text string, n int"


def csv_file(path, rows, line_end):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=line_end)
        writer.writerow(["id", "text", "n"])
        writer.writerows(rows)


@pytest.fixture
def tiny_ranges(spark):
    """Ranges of 300 bytes, far below a record of these files."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_one_file_in_many_ranges(spark, tmp_path, tiny_ranges, line_end):
    """Quotes, commas and line breaks lie across the borders, one text is longer than several ranges, some are empty."""
    texts = ['plain', 'a "quoted" word', 'two\nlines', 'comma, "x"\n\n"y"\n', 'é\n' * 700, '', '"', '\n', '""\n""', 'x' * 901]
    rows = [(i, texts[i % len(texts)] + ("!" * (i % 7) if i % len(texts) else ""), i % 5) for i in range(200)]
    csv_file(tmp_path / "one.csv", rows, line_end)
    got = csv_ranges.read_csv_ranges(spark, str(tmp_path / "one.csv"), SCHEMA)
    assert csv_ranges._lines(spark, str(tmp_path / "one.csv"), None).rdd.getNumPartitions() > 100
    want = readers.read_csv(spark, str(tmp_path / "one.csv"), SCHEMA)
    assert sorted(map(tuple, readers.fill_text(got).collect())) == sorted(map(tuple, readers.fill_text(want).collect()))
    assert sorted(tuple(r) for r in readers.fill_text(got).collect()) == sorted(rows)


def test_many_files_and_an_empty_one(spark, tmp_path, tiny_ranges):
    for k in range(3):
        csv_file(tmp_path / f"part-{k}.csv", [(10 * k + i, "a\nb" * i, None) for i in range(9)], "\r\n" if k else "\n")
    csv_file(tmp_path / "part-9.csv", [], "\n")
    got = csv_ranges.read_csv_ranges(spark, str(tmp_path), SCHEMA, path_filter="part-*.csv")
    assert sorted((r["id"], r["text"] or "", r["n"]) for r in got.collect()) == [(10 * k + i, "a\nb" * i, None) for k in range(3) for i in range(9)]


def test_a_carriage_return_inside_quotes_stays_in_a_file_of_plain_lines(spark, tmp_path, tiny_ranges):
    csv_file(tmp_path / "cr.csv", [(1, "a\r\nb", 0), (2, "c\rd", 0)], "\n")
    got = csv_ranges.read_csv_ranges(spark, str(tmp_path / "cr.csv"), SCHEMA)
    assert sorted((r["id"], r["text"]) for r in got.collect()) == [(1, "a\r\nb"), (2, "c\rd")]


def test_a_table_is_replaced_by_a_job_that_reads_it(spark, tmp_path):
    root = str(tmp_path / "t")
    assert snapshots.publish(spark.range(10), root) == 0
    pinned = snapshots.read_version(spark, root)
    assert snapshots.publish(pinned.filter("id < 4"), root) == 1
    assert snapshots.publish(snapshots.read_version(spark, root).selectExpr("id * 2 AS id"), root) == 2
    assert pinned.count() == 10 and sorted(r["id"] for r in snapshots.read_version(spark, root).collect()) == [0, 2, 4, 6]
    with pytest.raises(snapshots.SnapshotError):
        snapshots.read_version(spark, root, 7)


def test_a_failed_writer_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.publish(spark.range(5), root)
    with pytest.raises(Exception, match="(?i)zero"):
        snapshots.publish(spark.range(5).selectExpr("1 div (id - id) AS id"), root)
    assert list(snapshots.versions(spark, root)) == [0] and snapshots.read_version(spark, root).count() == 5


def test_two_writers_cannot_take_one_number(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    snapshots.publish(spark.range(5), root)
    seen = snapshots.versions(spark, root)
    snapshots.publish(spark.range(6), root)
    monkeypatch.setattr(snapshots, "versions", lambda *_: seen)  # the second writer looked before the first was done
    with pytest.raises(snapshots.SnapshotError):
        snapshots.publish(spark.range(7), root)


def test_expiry_keeps_new_pinned_and_fresh_data(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(5):
        snapshots.publish(spark.range(n + 1), root)
    orphan = tmp_path / "t" / "data" / "v-unpublished.parquet"
    orphan.mkdir()
    assert len(snapshots.expire(spark, root, keep=2, pinned=(1,))) == 2
    assert list(snapshots.versions(spark, root)) == [1, 3, 4] and orphan.exists()
    assert snapshots.read_version(spark, root, 1).count() == 2
    assert len(snapshots.expire(spark, root, keep=1, grace_seconds=-60)) == 3 and not orphan.exists()
    assert snapshots.publish(spark.range(9), root) == 5


def length_scorer(heard):
    """Scores a text by its length; ``heard`` is told how many rows were scored."""

    def load(k):
        def score(batch):
            heard.add(len(batch))
            n = batch["text"].str.len().to_numpy(float)
            return np.stack([n + k, n * 0, -n], axis=1)

        return score

    return load


def test_scoring_goes_on_where_it_was_killed(spark, tmp_path):
    rows = [(i, i % 3 if i % 10 else None, "x" * (i * 37 % 90) if i % 11 else None) for i in range(60)]
    prompts = spark.createDataFrame(rows, "id long, fold int, text string")
    root = str(tmp_path / "scores")

    def kill(number):
        if number == 1:
            raise KeyboardInterrupt

    asked = spark.sparkContext.accumulator(0)
    with pytest.raises(KeyboardInterrupt):
        scoring.score_texts(prompts, root, length_scorer(asked), ranges=(20, 50), on_commit=kill)
    early = {r["id"] for r in scoring.published_scores(spark, root).collect()}
    assert early == {i for i, _, t in rows if len(t or "") <= 50}
    got = scoring.score_texts(prompts, root, length_scorer(asked), ranges=(20, 50)).collect()
    want = {i: None if f is None else float(len(t or "") + f) for i, f, t in rows}
    assert len(got) == 60 and {r["id"]: r["logit_a"] for r in got} == want
    assert asked.value == sum(f is not None for _, f, _ in rows)  # no row was scored twice


def test_vocabulary_has_a_total_order_and_unknowns_of_their_own(spark):
    texts = ["b a a", "c b  a", None, "", "zz\tb d", " a\nb c "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    known = vocabulary.vocabulary(vocabulary.token_counts(df), 3, parts=3)
    assert [tuple(r) for r in known.orderBy("token_id").collect()] == [("a", 4, 1), ("b", 4, 2), ("c", 2, 3)]
    got = {r["id"]: (r["input_ids"], r["n_tokens"], r["n_unknown"]) for r in vocabulary.encode(df, known, max_len=2).collect()}
    assert got == {0: ([2, 1], 3, 0), 1: ([3, 2], 3, 0), 2: ([], 0, 0), 3: ([], 0, 0), 4: ([0, 2], 3, 2), 5: ([1, 2], 3, 0)}


def test_dense_ranks_equal_a_plain_sort_at_any_number_of_ranges(spark):
    words = [f"w{i * i % 211}" for i in range(1500)]
    counts = vocabulary.token_counts(spark.createDataFrame([(w,) for w in words], "text string"))
    want = {t: i + 1 for i, (t, _) in enumerate(sorted(Counter(words).items(), key=lambda x: (-x[1], x[0])))}
    for parts in (1, 7):
        got = vocabulary.vocabulary(counts, 10_000, parts).collect()
        assert {r["token"]: r["token_id"] for r in got} == want


def test_an_empty_table_gives_an_empty_vocabulary(spark):
    df = spark.createDataFrame([(1, None)], "id long, text string")
    known = vocabulary.vocabulary(vocabulary.token_counts(df), 3)
    assert known.count() == 0 and vocabulary.encode(df, known).collect()[0]["input_ids"] == []


def test_ids_are_looked_up_in_chunks_of_tokens():
    """A batch of 10,000 rows of 60 tokens, and a text of more tokens than a chunk."""
    texts = [[f"t{(i * j) % 97}" for j in range(60)] for i in range(10_000)] + [["t1", "x"] * vocabulary.CHUNK_TOKENS, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "_tokens"])
    known = [f"t{k}" for k in range(50)]
    tracemalloc.start()
    made = list(vocabulary.look_up(iter([batch]), known, np.arange(1, 51, dtype=np.int32), 20, ("id",)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sizes = [sum(b.column("n_tokens").to_pylist()) for b in made]
    assert len(made) > 8 and all(n <= vocabulary.CHUNK_TOKENS or b.num_rows == 1 for n, b in zip(sizes, made)) and peak < 20e6
    got = [r for b in made for r in b.to_pylist()]
    ids = {t: k + 1 for k, t in enumerate(known)}
    assert got == [{"id": i, "input_ids": [ids.get(t, 0) for t in x[:20]], "n_tokens": len(x), "n_unknown": sum(t not in ids for t in x)} for i, x in enumerate(texts)]
