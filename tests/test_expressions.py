import math

import pytest
from pyspark.sql import functions as F

from pairwright import schema
from pairwright.functions import labels, numbers, probs, records, text


def one(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression).first()[0]


@pytest.mark.parametrize(
    ("winners", "expected"),
    [((1, 0, 0), 0), ((0, 1, 0), 1), ((0, 0, 1), 2), ((0, 0, 0), 0), ((1, 1, 0), 0), ((0, 1, 1), 1), ((None, 1, 0), 1), ((None, None, None), None)],
)
def test_winner_class_takes_the_first_maximum(spark, winners, expected):
    df = spark.createDataFrame([winners], "winner_model_a int, winner_model_b int, winner_tie int")
    assert df.select(labels.winner_class()).first()[0] == expected


def test_prob_class_ties_and_unknowns(spark):
    df = spark.createDataFrame([(1 / 3, 1 / 3, 1 / 3), (0.1, 0.45, 0.45), (0.1, 0.2, 0.7), (None, 0.5, 0.5)], "a double, b double, t double")
    assert [r[0] for r in df.select(labels.prob_class(("a", "b", "t"))).collect()] == [0, 1, 2, None]


def test_labels(spark):
    df = spark.createDataFrame([(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (1, 1, 0)], "winner_model_a int, winner_model_b int, winner_tie int")
    rows = df.select(labels.winner_label(), labels.winners_valid()).collect()
    assert [r[0] for r in rows] == ["A", "B", "Tie", "Tie", "A"]
    assert [r[1] for r in rows] == [True, True, True, False, False]


def test_uniform_row_costs_ln_3(spark):
    loss = probs.one_hot_loss(("p", "p", "p"), ("w1", "w0", "w0"))
    assert one(spark, loss, p=1 / 3, w1=1, w0=0) == pytest.approx(math.log(3))


def test_zero_probability_is_clipped(spark):
    assert one(spark, probs.class_loss("y", ("p", "q", "q")), y=0, p=0.0, q=0.5) == pytest.approx(-math.log(1e-15))
    assert one(spark, probs.class_loss("y", ("p", "q", "q")), y=0, p=1.0, q=0.0) == pytest.approx(1e-15, abs=2e-15)


def test_nan_probability_has_no_loss(spark):
    assert one(spark, probs.class_loss("y", ("p", "q", "q")), y=0, p=float("nan"), q=0.5) is None


def test_softmax_is_stable_and_sums_to_one(spark):
    df = spark.createDataFrame([(1000.0, 1001.0, 999.0), (-5.0, 0.0, 5.0)], "a double, b double, c double")
    for row in df.select(*probs.softmax(("a", "b", "c"))).collect():
        assert sum(row) == pytest.approx(1.0) and all(0 <= v <= 1 for v in row)
    soft = df.select(*probs.softmax(("a", "b", "c"), 2.0)).collect()[1]
    logs = df.select(*probs.log_softmax(("a", "b", "c"), 2.0)).collect()[1]
    assert [math.log(v) for v in soft] == pytest.approx(list(logs))


def test_blend_normalises_its_weights(spark):
    mixed = probs.blend([("a", "b", "b"), ("b", "a", "b")], [3, 1])
    assert one(spark, mixed[0], a=0.8, b=0.1) == pytest.approx(0.75 * 0.8 + 0.25 * 0.1)
    with pytest.raises(ValueError):
        probs.normalise([0, 0])


@pytest.mark.parametrize("value", [float("nan"), float("inf"), float("-inf"), None])
def test_unusable_numbers(spark, value):
    df = spark.createDataFrame([(value,), (1.5,)], "x double")
    assert [r[0] for r in df.select(numbers.unusable_to_zero(F.col("x"))).collect()] == [0.0, 1.5]
    assert [r[0] for r in df.select(numbers.unusable_to_null(F.col("x"))).collect()] == [None, 1.5]


NASTY = 'quote " comma , brace {p} {} percent %s back\\slash\nnew line'


def test_templates_take_text_as_it_is(spark):
    df = spark.createDataFrame([(NASTY, None, "b")], "prompt_text string, res_a_text string, res_b_text string")
    joined, judged = df.select(text.join_with_separator(), text.judge_prompt()).first()
    assert joined == f"{NASTY} [SEP]  [SEP] b"
    assert judged == text.JUDGE_TEMPLATE.replace("{b}", "b").replace("{a}", "").replace("{p}", NASTY)
    assert judged.startswith("<|im_start|>system\nYou are a helpful") and judged.endswith("<|im_start|>assistant\n")


def test_short_template_caps_every_field(spark):
    df = spark.createDataFrame([("é" * 1300, "a", None)], "prompt_text string, res_a_text string, res_b_text string")
    assert df.select(text.short_judge_prompt()).first()[0].count("é") == 1200


def test_tokens(spark):
    df = spark.createDataFrame([("  a\tb\r\n c ",), ("",), (None,)], "t string")
    rows = df.select(text.whitespace_tokens("t"), text.token_count("t")).collect()
    assert [list(r[0]) for r in rows] == [["a", "b", "c"], [], []]
    assert [r[1] for r in rows] == [3, 0, 0]


@pytest.mark.parametrize(
    ("line", "kind", "loss"),
    [
        ("{'loss': 1.25, 'epoch': 0.5}", "train", 1.25),
        ("12% step {'eval_loss': 0.9, 'loss': 3, 'epoch': 1}  ", "eval", 0.9),
        ("{'loss': nan, 'epoch': 0.5}", None, None),
        ("{'loss': 1.0}", None, None),
        ("{'epoch': 1.0}", None, None),
        ("no record", None, None),
        ("{'loss': 1.0, 'epoch': 0.5} trailing", None, None),
        ("{'loss': 1.0, 'epoch': 0.5} {'loss': 2.0, 'epoch': 0.5}", None, None),
        ("{broken", None, None),
        ("odd } start {'loss': 1.0, 'epoch': 0.5}", "train", 1.0),
        ("x" * 200_000 + "{'loss': 1.0, 'note': '" + "y" * 200_000 + "', 'epoch': 0.5}", "train", 1.0),
        ("", None, None),
    ],
)
def test_log_lines(spark, line, kind, loss):
    df = spark.createDataFrame([(line,)], "value string").select(F.inline(F.array(records.log_record("value"))))
    row = df.select(records.record_kind(), records.record_loss()).first()
    assert row[0] == kind and (kind is None or row[1] == loss)


def test_paths(spark):
    assert one(spark, records.checkpoint_step("p"), p="out/checkpoint-4600") == 4600
    assert one(spark, records.checkpoint_step("p"), p="out/other") == 0
    assert one(spark, records.basename("p"), p="a/b/checkpoint-9") == "checkpoint-9"
    assert one(spark, records.model_type("p"), p="M1_Fold0") == "M1"


def test_schema_guards(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2, 0.7)], "id long, pred_a double, pred_b double, pred_tie double")
    mapping = dict(zip(schema.PREDS, schema.TEACHER))
    renamed = schema.rename_if_present(df, mapping)
    assert renamed.columns == ["id", *schema.TEACHER]
    assert schema.rename_if_present(renamed, mapping).columns == renamed.columns
    with pytest.raises(schema.SchemaError):
        schema.rename_if_present(df.select("id"), mapping)


def test_feature_choice(spark):
    df = spark.createDataFrame([(1, 2.0, 3, 0, 1, 0, 0.1, 0.2, 0.7)], "id long, len_p double, cluster_id_k20 int, winner_model_a int, winner_model_b int, winner_tie int, x_a double, x_b double, x_tie double")
    assert schema.feature_set(df) == ["len_p", "cluster_id_k20"]
    assert schema.feature_set(df, ["x"], manual=False) == ["x_a", "x_b", "x_tie"]
    assert schema.feature_set(df, ["x"]) == ["len_p", "cluster_id_k20", "x_a", "x_b", "x_tie"]
    assert schema.categorical_columns(["len_p", "cluster_id_k20", "is_code_task"]) == ["cluster_id_k20", "is_code_task"]
    assert schema.columns_like(df, prefix="winner", exclude=("winner_tie",)) == ["winner_model_a", "winner_model_b"]
    assert schema.numeric_columns(df, exclude=schema.WINNERS)[:2] == ["id", "len_p"]
    with pytest.raises(schema.SchemaError):
        schema.feature_set(df, [], manual=False)
