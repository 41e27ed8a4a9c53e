"""Sources, sinks, cleaning, looking at rows, preparation, profiles, curves."""

import json
import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pairwright import session
from pairwright.operators import cleaning, curves, explore, features, preference, profile
from pairwright.schema import PREFERENCE_SCHEMA
from pairwright.sources import readers, writers

TEXTS = [
    'plain',
    'quote " and ""doubled""',
    "comma, semicolon; tab\t",
    "line\nbreak\r\nand more\n",
    "  spaces around  ",
    "braces {p} {} percent %s",
    "back\\slash \\n \\\" end\\",
    "accents é ü — and emoji \U0001f600",
    "",
    "'single' # hash",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, t[::-1], i % 3) for i, t in enumerate(TEXTS)] + [(99, None, "x", None)]
    return spark.createDataFrame(rows, "id long, a string, b string, n int")


def contents(df):
    return sorted(tuple(r) for r in df.select("id", "a", "b", "n").collect())


def test_csv_keeps_every_character(spark, texts, tmp_path):
    path = writers.write_csv(texts, str(tmp_path / "t.csv"), max_rows_per_file=4)
    back = readers.fill_text(readers.read_table(spark, path, texts.schema))
    assert [(i, a, b, n if n is not None else -1) for i, a, b, n in contents(back.fillna(-1))] == [
        (i, a, b, n) for i, a, b, n in contents(cleaning.clean_text(texts).fillna(-1))
    ]


def test_csv_line_ends_do_not_matter(spark, texts, tmp_path):
    plain = texts.filter("NOT coalesce(contains(a, chr(13)), false)")
    got = []
    for name, end in (("lf", "\n"), ("crlf", "\r\n")):
        path = writers.write_csv(plain, str(tmp_path / f"{name}.csv"), line_end=end)
        got.append(contents(readers.fill_text(readers.read_csv(spark, path, plain.schema)).fillna(-1)))
    assert got[0] == got[1] and {r[3] for r in got[0]} == {-1, 0, 1, 2}


def test_path_filter_holds_for_csv(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("id\n1\n")
    assert readers.read_table(spark, str(tmp_path / "*.csv"), "id int", path_filter="a.*").count() == 1
    assert readers.read_table(spark, str(tmp_path / "*.csv"), "id int").count() == 2


def test_a_json_file_is_one_document(spark, tmp_path):
    (tmp_path / "x.json").write_text('{\n "best_model_checkpoint": "checkpoint-3"\n}')
    assert readers.read_table(spark, str(tmp_path / "x.json"), "best_model_checkpoint string").first()[0] == "checkpoint-3"


def test_unknown_clusters_stay_unknown(spark):
    df = spark.createDataFrame([(None, 1, 0.5), (3, None, None)], "cluster_id_k20 int, n int, x double")
    assert [tuple(r) for r in cleaning.clean_features(df).collect()] == [(None, 1, 0.5), (3, 0, 0.0)]


def test_jsonl_keeps_every_character_and_null(spark, texts, tmp_path):
    path = writers.write_jsonl(texts, str(tmp_path / "t.jsonl"))
    assert '"a":null' in "".join(r[0] for r in spark.read.text(path).collect())
    back = readers.read_table(spark, path, texts.schema)
    assert set(map(str, contents(back.fillna(-1).fillna("?")))) == set(map(str, contents(texts.fillna(-1).fillna("?"))))


def test_reader_choice_and_globs(spark, tmp_path):
    for i in range(3):
        writers.write_parquet(spark.range(i + 1), str(tmp_path / f"part{i}.parquet"))
    assert readers.read_table(spark, str(tmp_path / "part*.parquet")).count() == 6
    (tmp_path / "a.log").write_text("{'loss': 1, 'epoch': 1}\nx\n")
    assert readers.read_table(spark, str(tmp_path / "a.log")).count() == 2
    assert [r["run"] for r in readers.read_logs(spark, str(tmp_path / "*.log")).collect()] == ["a", "a"]


def test_optional_sources(spark, tmp_path):
    assert readers.read_optional(spark, str(tmp_path / "none.parquet")) is None
    with pytest.raises(AnalysisException):
        readers.read_optional(spark, str(tmp_path / "none.csv"), "a int", on_missing="raise")
    writers.write_parquet(spark.range(1), str(tmp_path / "some.parquet"))
    found = readers.read_available(spark, {"some": str(tmp_path / "some.parquet"), "none": str(tmp_path / "none.parquet")})
    assert list(found) == ["some"]


def test_new_versions_leave_the_old_one(spark, tmp_path):
    first = writers.write_new_version(spark.range(3), str(tmp_path))
    second = writers.write_new_version(readers.read_table(spark, first).filter("id > 0"), str(tmp_path))
    assert first != second and readers.read_table(spark, first).count() == 3 and readers.read_table(spark, second).count() == 2


class FakeSession:
    def __init__(self, **conf):
        settings = {k.replace("_", "."): v for k, v in conf.items()}
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: settings.get(key, default))})


def test_shared_folder_comes_from_the_session():
    configured = FakeSession(spark_checkpoint_dir="hdfs://shared/dir/", spark_master="yarn")
    assert session.new_path(configured, "x").startswith("hdfs://shared/dir/pairwright/x-")
    assert session.shared_root(FakeSession(spark_master="local[2]")).startswith("/")
    with pytest.raises(RuntimeError):
        session.shared_root(FakeSession(spark_master="yarn"))


def test_run_state_documents(spark, tmp_path):
    for run, body in {"r1": {"best_model_checkpoint": "o/r1/checkpoint-20"}, "r2": {"other": 1}}.items():
        (tmp_path / f"run={run}").mkdir()
        (tmp_path / f"run={run}" / "trainer_state.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "run=r3").mkdir()
    (tmp_path / "run=r3" / "trainer_state.json").write_text("{broken")
    states = readers.read_documents(spark, str(tmp_path))
    paths = spark.createDataFrame(
        [("r1", "o/r1/checkpoint-20"), ("r1", "o/r1/checkpoint-100"), ("r2", "o/r2/checkpoint-900"), ("r2", "o/r2/checkpoint-4600"), ("r2", "o/r2/other"), ("r3", "o/r3/checkpoint-5")],
        "run string, path string",
    )
    got = {r["run"]: (r["checkpoint"], r["chosen_by"]) for r in curves.resolve_checkpoint(states, paths).collect()}
    assert got == {"r1": ("o/r1/checkpoint-20", "best"), "r2": ("o/r2/checkpoint-4600", "latest"), "r3": ("o/r3/checkpoint-5", "latest")}


def test_best_checkpoint_prefers_the_earlier_of_equals(spark):
    evals = spark.createDataFrame([("r", "checkpoint-300", 0.5), ("r", "checkpoint-1000", 0.5), ("r", "checkpoint-20", 0.9)], "run string, checkpoint string, loss double")
    assert curves.best_checkpoint(evals).first()["best_model_checkpoint"] == "checkpoint-300"


# ---------------------------------------------------------------- cleaning


def test_clean_policies(spark):
    df = spark.createDataFrame([(float("nan"), None, 1, "x"), (float("-inf"), 2, 1, "y"), (3.0, 4, 1, "z")], "f double, i int, cluster_id int, s string")
    zero = cleaning.clean_features(df)
    assert [tuple(r) for r in zero.collect()] == [(0.0, 0, "x"), (0.0, 2, "y"), (3.0, 4, "z")]
    assert [tuple(r) for r in cleaning.clean_features(df, "null").collect()] == [(None, None, "x"), (None, 2, "y"), (3.0, 4, "z")]
    report = {r["feature"]: r for r in cleaning.cleaning_report(df).collect()}
    assert (report["f"]["n_nan"], report["f"]["n_inf"], report["i"]["n_null"]) == (1, 1, 1)


def test_winner_audit(spark):
    df = spark.createDataFrame([(1, 0, 0), (0, 0, 0), (1, 1, 0)], "winner_model_a int, winner_model_b int, winner_tie int")
    assert cleaning.winner_audit(df).first().asDict() == {"n_rows": 3, "n_valid": 1, "n_invalid": 2}


# ---------------------------------------------------------------- looking at rows


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(1000, numPartitions=4)
    first = [r["id"] for r in explore.sample_rows(df, 20).collect()]
    assert len(set(first)) == 20 and sorted(first) == sorted(r["id"] for r in explore.sample_rows(df.repartition(9), 20).collect())
    assert explore.sample_or_none(df, 1001) is None and explore.sample_or_none(df, 5).count() == 5


def test_worst_cases_break_ties_by_key(spark):
    df = spark.createDataFrame([(i, 0, 1, 0, 0, 0.5, 0.3, 0.2) for i in (5, 3, 9)], "id long, cluster_id_k20 int, winner_model_a int, winner_model_b int, winner_tie int, pred_a double, pred_b double, pred_tie double")
    worst = explore.bad_cases(df, 2)
    assert [r["id"] for r in worst.collect()] == [3, 5]
    texts = spark.createDataFrame([(i, "p" * 300) for i in (3, 5, 9)], "id long, prompt_text string")
    cards = explore.case_cards(explore.attach_text(worst, texts)).collect()
    assert len(cards) == 2 and all(c["prompt_head"] == "p" * 200 + "..." and c["winner"] == "A" for c in cards)


# ---------------------------------------------------------------- preparation


def test_triples(spark):
    rows = [(1, 1, 0, 0), (2, 0, 1, 0), (3, 0, 0, 1), (4, 0, 0, 0), (5, 1, 1, 0)]
    df = spark.createDataFrame([(i, "p", "a", None, *w) for i, *w in rows], "id long, prompt_text string, res_a_text string, res_b_text string, winner_model_a int, winner_model_b int, winner_tie int")
    triples = preference.preference_triples(df)
    assert triples.schema.names == PREFERENCE_SCHEMA.names
    assert sorted(tuple(r) for r in triples.collect()) == [("p", "", "a"), ("p", "a", "")]
    assert preference.triple_audit(df).first().asDict() == {"n_triples": 2, "n_ties": 1, "n_invalid": 2}


def test_any_tokenizer_can_be_plugged_in(spark):
    df = spark.createDataFrame([(1, "a bb ccc"), (2, ""), (3, None)], "id long, text string")

    def load():
        return lambda texts: [[len(w) for w in t.split()] for t in texts]

    got = {r["id"]: (list(r["input_ids"]), r["n_tokens"]) for r in preference.tokenize_with(df, load, max_len=2).collect()}
    assert got == {1: ([1, 2], 3), 2: ([], 0), 3: ([], 0)}


def test_vocabulary_file(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path, text = str(tmp_path / "words.json"), "Evaluate the two responses, please."
    words = tokenizers.Tokenizer(tokenizers.models.WordLevel({"[UNK]": 0, "the": 1, "two": 2, "please": 3, ".": 4}, unk_token="[UNK]"))
    words.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    words.save(path)
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = preference.tokenize_with(df, preference.vocabulary_encoder(path)).first()["input_ids"]
    assert list(got) == tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_truncation_report(spark):
    df = spark.createDataFrame([(1,), (5,), (10,)], "n_tokens int")
    rows = {r["max_len"]: r for r in preference.truncation_report(df, caps=(4, 10)).collect()}
    assert rows[4]["n_cut"] == 2 and rows[4]["mean_kept"] == pytest.approx(3.0) and rows[10]["n_cut"] == 0


def test_style_flags_and_cosine(spark):
    rows = [
        (1, "Write python code", "- item one\nThank you", "I can't do that. 1) no"),
        (2, "hi", "decode thankful", "same same words"),
        (3, None, "x y y", "y x y"),
        (4, "q", "", "z"),
        (5, "q", "note\n  12. twelve ✅", "```py\n```"),
    ]
    df = spark.createDataFrame(rows, "id long, prompt_text string, res_a_text string, res_b_text string")
    got = {r["id"]: r for r in features.pair_features(df).collect()}
    assert got[1]["is_code_task"] == 1 and got[1]["has_list_a"] == 1 and got[1]["is_polite_a"] == 1 and got[1]["is_refusal_b"] == 1
    assert got[1]["has_list_b"] == 0 and got[2]["is_code_task"] == 0 and got[2]["is_polite_a"] == 0
    assert got[5]["has_list_a"] == 1 and got[5]["has_emoji_a"] == 1 and got[5]["has_code_b"] == 1
    assert got[3]["len_p"] == 0 and got[3]["len_diff"] == 0 and got[4]["len_ratio"] == 0
    cosine = {r["id"]: r["c"] for r in df.select("id", features.token_cosine().alias("c")).collect()}
    assert cosine[3] == pytest.approx(1.0) and cosine[2] == 0.0 and cosine[4] == 0.0


def test_cosine_holds_the_tokens_of_a_chunk_only():
    """Memory of 6,000 pairs of 200 words; one pair is larger than a chunk, some texts are empty."""
    rng = np.random.default_rng(4)
    texts = [[" ".join(f"w{k}" for k in rng.integers(0, 300, 0 if i % 50 == 0 else 200)) for i in range(6000)] for _ in range(2)]
    texts[0][70] = "w1 w2\n" * 300_000
    a, b = (pa.array(t) for t in texts)
    tracemalloc.start()
    got = features.chunked_cosines(a, b).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and len(got) == 6000
    for i in (0, 1, 70, 71, 3050, 5999):
        x, y = (Counter(t[i].split()) for t in texts)
        norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        assert got[i] == pytest.approx(sum(v * y[k] for k, v in x.items()) / norm if norm else 0.0, abs=1e-12)
    assert features.chunked_cosines(a[:0], b[:0]).to_pylist() == []


# ---------------------------------------------------------------- profiles


def numpy_quantiles(values):
    return np.quantile(np.array(values, dtype=float), [0.25, 0.5, 0.75]).tolist()


@pytest.mark.parametrize("tasks", [1, 9])
def test_exact_quantiles_equal_sorting(spark, tasks):
    rng = np.random.default_rng(1)
    n = 3001
    columns = {
        "even": rng.normal(size=n),
        "third": np.where(np.arange(n) % 3 == 0, 7.0, rng.exponential(size=n)),
        "flag": (rng.random(n) < 0.3).astype(float),
        "same": np.full(n, 2.5),
        "wild": np.concatenate([[1e300, -1e300], rng.normal(size=n - 2)]),
    }
    df = spark.createDataFrame([tuple(float(columns[c][i]) for c in columns) for i in range(n)], ", ".join(f"{c} double" for c in columns))
    got = profile.exact_quantiles(df.repartition(tasks), list(columns))
    for name, values in columns.items():
        assert got[name] == pytest.approx(numpy_quantiles(values)), name


def test_bits_sort_like_doubles_and_come_back():
    x = np.sort(np.array([-np.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1e-9, 2.5, 1e300, np.inf]))
    bits = profile._to_bits(x)
    assert (np.diff(bits.astype(object)) > 0).all() and [profile._from_bits(int(b)) for b in bits] == x.tolist()
    assert profile._to_bits(np.array([-0.0])) == profile._to_bits(np.array([0.0]))


def test_quantiles_of_close_and_signed_values(spark):
    """Values that differ in the last of 64 bits, both zeros, NULL and NaN; every rank of a small column."""
    x = [1.0 + k * 2**-52 for k in range(7)] + [-0.0, 0.0, -3.0, float("nan"), None]
    df = spark.createDataFrame([(v, None) for v in x], "x double, none double")
    levels = [k / 9 for k in range(10)]
    got = profile.exact_quantiles(df, ["x", "none"], levels)
    assert got["x"] == pytest.approx(np.quantile(np.array(x[:-2], float), levels).tolist(), abs=0) and got["none"] == [None] * 10


def test_profile_plans_have_no_window(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    plan = profile._radix_pass(df, [[0, 50, 0, 50]], 48)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan


def test_profile_edges(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (2.0, None, float("inf"))], "a double, none double, odd double")
    rows = {r["feature"]: r for r in profile.column_profile(df, {"g": ["a", "none", "odd"]}).collect()}
    assert rows["a"]["q50"] == 1.5 and rows["a"]["std"] == 0.71
    assert rows["none"]["count"] == 0 and rows["none"]["q50"] is None
    assert rows["odd"]["count"] == 1 and math.isinf(rows["odd"]["q25"])
    approximate = {r["feature"]: r for r in profile.column_profile(df, {"g": ["a"]}, quantiles="approximate").collect()}
    assert approximate["a"]["q50"] in (1.0, 2.0)


def test_feature_groups(spark):
    df = spark.createDataFrame([(1.0,) * 6], "len_p double, has_list_a double, has_emoji_a double, cluster_id_k20 double, a_x_b double, other double")
    assert features.feature_groups(df) == {
        "Length & Ratio": ["len_p"], "Formatting": ["has_list_a"], "Style & Semantic": ["has_emoji_a"], "Topic & Task": ["cluster_id_k20"], "Interaction": ["a_x_b"],
    }


def test_curves_count_records_per_epoch(spark):
    lines = spark.createDataFrame([("M_1", "{'loss': 1.0, 'epoch': 1.0}"), ("M_2", "{'loss': 3.0, 'epoch': 1.0}"), ("M_1", "junk")], "run string, value string")
    row = curves.curve_by_type(curves.parse_logs(lines)).first()
    assert (row["model_type"], row["n"], row["mean_loss"]) == ("M", 2, 2.0) and row["sd_loss"] == pytest.approx(math.sqrt(2))
    assert curves.curve_by_run(curves.parse_logs(lines)).count() == 2


def test_bracketed_display(spark):
    df = spark.createDataFrame([(1, 0, 1, 0, "p", "a", "b")], "id long, winner_model_a int, winner_model_b int, winner_tie int, prompt_text string, res_a_text string, res_b_text string")
    assert explore.sample_cards(df).first()["winner"] == "Model B"
    assert explore.head_rows(df, ["prompt_text"]).first()[0] == "p"
    assert explore.conflicts(spark.createDataFrame([(600.0, 0.1, 0.2), (600.0, 0.3, 0.2), (10.0, 0.1, 0.2)], "len_diff double, pred_a double, pred_b double")).count() == 1
