"""The registered queries. Each reads whole tables below ``sf_dir`` and returns a DataFrame."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.labels import winner_label
from pairwright.functions.probs import one_hot_loss
from pairwright.functions.text import FIELD_CAP, prefix, token_count
from pairwright.operators import (
    alignment,
    boosting,
    cleaning,
    curves,
    density,
    distill,
    encoding,
    ensemble,
    explore,
    features,
    folds,
    metrics,
    preference,
    profile,
    scoring,
    vocabulary as vocabularies,
)
from pairwright.operators.rows import round_columns, unpivot
from pairwright.plans import inputs
from pairwright.plans.inputs import MODELS
from pairwright.schema import (
    CLUSTER,
    FOLD,
    ID,
    N_FOLDS,
    PAIR_SCHEMA,
    PREDS,
    PREFERENCE_SCHEMA,
    TEACHER,
    TEXTS,
    WINNERS,
    categorical_columns,
    feature_columns,
    feature_set,
    fractional_columns,
)
from pairwright.session import new_path
from pairwright.sources import csv_ranges, readers, snapshots, writers
from pairwright.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
#: Size of the vocabularies of the registered queries.
VOCABULARY = 2_000
BLEND_WEIGHTS = {"m1": 0.45, "m2": 0.30, "m3": 0.25}
RUN_FOLDER = r"run=([^/]+)/"
OOF_COLUMNS = f"{ID} long, " + ", ".join(f"{p} double" for p in PREDS)


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every fractional column to six digits, so that summation order cannot show."""
    return round_columns(df, fractional_columns(df), digits)


# ---------------------------------------------------------------- evaluation


@query
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.model_metrics(inputs.predictions(spark, sf_dir), MODELS))


@query
def class_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_table(inputs.predictions(spark, sf_dir), MODELS)


@query
def sample_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.sample_loss(inputs.predictions(spark, sf_dir), MODELS))


@query
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.fold_metrics(inputs.folded(spark, sf_dir), MODELS))


@query
def cv_mean_of_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_fold = metrics.fold_metrics(inputs.folded(spark, sf_dir), MODELS)
    return rounded(metrics.mean_of_folds(by_fold))


@query
def cluster_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cluster_loss(inputs.predictions(spark, sf_dir), MODELS))


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion_matrix(inputs.predictions(spark, sf_dir), MODELS))


@query
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_report(inputs.predictions(spark, sf_dir), MODELS))


@query
def softmax_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = _logits(inputs.predictions(spark, sf_dir), "m1")
    return rounded(metrics.softmax_probs(logits, scoring.LOGITS).select(ID, *PREDS))


@query
def logit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inputs.predictions(spark, sf_dir)
    scaled = df.withColumns({c: F.col(c) * 3 for cols in MODELS.values() for c in cols})
    return rounded(metrics.logit_metrics(scaled, MODELS))


@query
def confidence_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.confidence_density(inputs.predictions(spark, sf_dir), {m: cols[0] for m, cols in MODELS.items()}))


@query
def bad_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worst(spark, sf_dir, 50).select(ID, CLUSTER, "sample_loss")


@query
def bad_case_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.value_counts(_worst(spark, sf_dir, 50), CLUSTER)


@query
def bad_case_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = _worst(spark, sf_dir, 3)
    prompts = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias(ID), F.col("text").alias("prompt_text"))
    return explore.case_cards(explore.attach_text(worst, prompts), MODELS["m1"])


def _worst(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return explore.bad_cases(inputs.predictions(spark, sf_dir), n, MODELS["m1"])


def _logits(df: DataFrame, model: str) -> DataFrame:
    return df.withColumns({logit: F.col(c) * 4 for logit, c in zip(scoring.LOGITS, MODELS[model])})


# ---------------------------------------------------------------- folds


@query
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.folded(spark, sf_dir).select(ID, "stratify_group", FOLD)


@query
def stratified_folds_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inputs.predictions(spark, sf_dir).select(ID, *WINNERS)
    return folds.assign_folds(df, folds.stratum_by_target(), keep_stratum="target").select(ID, "target", FOLD)


@query
def fold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_counts(inputs.folded(spark, sf_dir))


@query
def fold_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_balance(inputs.folded(spark, sf_dir), "stratify_group")


@query
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.split_counts(inputs.folded(spark, sf_dir))


# ---------------------------------------------------------------- alignment


@query
def align_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inputs.predictions(spark, sf_dir)
    outputs = {f"x{m}": inputs.model_output(df, m) for m in MODELS}
    return rounded(alignment.align_models(df.select(ID, CLUSTER), outputs))


@query
def align_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models aligned where a third of all rows share one key: their number and the sums of their probabilities, in millionths, per cluster."""
    known = inputs.predictions(spark, sf_dir)
    hot = known.withColumn(ID, F.when(F.col(ID) % 3 == 0, 0).otherwise(F.col(ID)))
    outputs = {f"x{m}": inputs.model_output(known, m) for m in ("m1", "m2")}
    table = alignment.align_models(hot.select(ID, CLUSTER), outputs, split_hot=True)
    sums = [F.sum(F.round(F.col(f"x{m}_{s}") * 1e6).cast("long")).alias(f"sum_{m}_{s}") for m in ("m1", "m2") for s in ("a", "b", "tie")]
    return table.groupBy(CLUSTER).agg(F.count(F.lit(1)).alias("n"), *sums)


@query
def scoring_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows packed in the column order of a saved model, in millionths."""
    trained_on = ["m2_a", "m1_tie", "m1_a"]
    table = alignment.select_like_model(inputs.predictions(spark, sf_dir), trained_on)
    packed = [F.round(F.col(c) * 1e6).cast("long").cast("string") for c in table.columns if c != ID]
    return table.select(ID, F.concat_ws(" ", *packed).alias("vector"))


@query
def fold_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of the folds, stored one by one, stacked again and marked with their fold."""
    root = writers.write_parquet(inputs.folded(spark, sf_dir).select(ID, FOLD), new_path(spark, "folds"), partition_by=(FOLD,))
    return alignment.union_folds({k: readers.read_table(spark, f"{root}/{FOLD}={k}") for k in range(N_FOLDS)})


@query
def feature_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known values of the features of three choices: manual ones, one model, both with two models."""
    known = inputs.predictions(spark, sf_dir)
    choices = {"manual": feature_set(known), "m1": feature_set(known, ["m1"], manual=False), "all": feature_set(known, ["m1", "m3"])}
    counts = known.agg(*[F.count(c).alias(c) for c in dict.fromkeys(c for names in choices.values() for c in names)])
    rows = [{"choice": F.lit(name), "feature": F.lit(c), "n": F.col(c)} for name, names in choices.items() for c in names]
    return unpivot(counts, [], rows)


@query
def alignment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_audit(inputs.predictions(spark, sf_dir), inputs.misaligned_output(spark, sf_dir))


@query
def label_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = inputs.predictions(spark, sf_dir)
    return rounded(alignment.backfill(inputs.misaligned_output(spark, sf_dir), labels, [CLUSTER, *WINNERS]))


@query
def oof_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.oof_completeness(inputs.folded(spark, sf_dir), inputs.misaligned_output(spark, sf_dir))


@query
def winner_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes with some flags set twice and some not at all."""
    flawed = inputs.predictions(spark, sf_dir).selectExpr(
        f"IF({ID} % 43 = 0, 0, winner_model_a) AS winner_model_a", "winner_model_b", f"IF({ID} % 41 = 0, 1, winner_tie) AS winner_tie"
    )
    return cleaning.winner_audit(flawed)


@query
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.row_counts({name: inputs.table(spark, sf_dir, name) for name in TABLES})


@query
def teacher_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inputs.folded(spark, sf_dir)
    teacher = inputs.model_output(inputs.predictions(spark, sf_dir), "m3")
    joined = alignment.teacher_table(df.select(ID, FOLD, *WINNERS), teacher)
    probs = [F.col("teacher_probs")[i].alias(f"teacher_prob_{i}") for i in range(3)]
    return rounded(joined.select(ID, FOLD, "labels", *TEACHER, F.size("teacher_probs").alias("n_probs"), *probs))


@query
def backfilled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over labels that were left-joined onto a misaligned table, with missing probabilities in some rows."""
    found = inputs.gappy(inputs.misaligned_output(spark, sf_dir))
    labelled = alignment.backfill(found, inputs.predictions(spark, sf_dir), [CLUSTER, *WINNERS])
    return rounded(metrics.model_metrics(labelled, {"oof": PREDS}))


@query
def row_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that enter operators with missing keys, folds and labels, rows with a result, and rows reported without one."""
    known = inputs.predictions(spark, sf_dir)
    keyless = known.withColumn(ID, F.when(F.col(ID) % 13 != 0, F.col(ID)))
    dealt = folds.assign_folds(keyless.select(ID, CLUSTER, *WINNERS), folds.stratum_by_cluster())
    holes = inputs.folded(spark, sf_dir).withColumn(FOLD, F.when(F.col(ID) % 17 != 0, F.col(FOLD)))
    scored = scoring.score_folds(holes, scoring.linear_models(_coefficients()), SCORER_INPUTS)
    measured = metrics.fold_metrics(holes, {"m1": MODELS["m1"]})
    balances = {
        "assign_folds": dealt.agg(F.count(FOLD).alias("rows_out"), F.count_if(F.col(FOLD).isNull()).alias("rows_reported")),
        "score_folds": scored.agg(F.count("logit_a").alias("rows_out"), F.count_if(F.col("logit_a").isNull()).alias("rows_reported")),
        "fold_metrics": measured.agg(
            F.sum(F.when(F.col(FOLD).isNotNull(), F.col("n")).otherwise(0)).alias("rows_out"),
            F.sum(F.when(F.col(FOLD).isNull(), F.col("n")).otherwise(0)).alias("rows_reported"),
        ),
    }
    entered = known.agg(F.count(F.lit(1))).scalar()
    return alignment.tagged_union(balances, "operator").withColumn("rows_in", entered)


# ---------------------------------------------------------------- preparation


@query
def dpo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_triples(inputs.pairs(spark, sf_dir), keep=(ID,))


@query
def render_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.rendered(inputs.pairs(spark, sf_dir), "concat")


@query
def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.rendered(inputs.pairs(spark, sf_dir), "judge")


@query
def render_prompt_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.rendered(inputs.pairs(spark, sf_dir, head=FIELD_CAP), "judge_short")


@query
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent tokens of all documents, with dense ids."""
    return vocabularies.vocabulary(vocabularies.token_counts(inputs.table(spark, sf_dir, "documents")), VOCABULARY)


@query
def pretokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts as ids of a vocabulary made from the same prompts."""
    shown = preference.rendered(inputs.pairs(spark, sf_dir, head=FIELD_CAP), "judge_short")
    prompts = readers.read_table(spark, writers.write_parquet(shown, new_path(spark, "prompts") + ".parquet"))
    known = vocabularies.vocabulary(vocabularies.token_counts(prompts), VOCABULARY)
    path = writers.write_parquet(vocabularies.encode(prompts, known, max_len=2048), new_path(spark, "tokens"))
    ids = F.array_join(F.transform("input_ids", lambda t: t.cast("string")), " ")
    return readers.read_table(spark, path).select(ID, "n_tokens", "n_unknown", F.size("input_ids").alias("n_kept"), F.md5(ids).alias("ids_md5"))


@query
def batched_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a tokenizer of the user's, a batch at a time; this one's ids are the lengths of words."""
    cut = preference.tokenize_with(inputs.table(spark, sf_dir, "documents"), _length_encoder, max_len=64, keep=("doc_id",))
    total = F.aggregate("input_ids", F.lit(0), lambda a, x: a + x)
    return cut.select("doc_id", "n_tokens", F.size("input_ids").alias("n_kept"), total.alias("sum_ids"))


def _length_encoder() -> preference.Encoder:
    word = re.compile(r"[^ \t\n\r\f]+")
    return lambda texts: [[len(w) for w in word.findall(t)] for t in texts]


@query
def truncation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = inputs.pair_measures(spark, sf_dir, {"n": token_count("text")})
    # the two separators of the joined text are tokens of their own
    total = (F.col("p_n") + F.col("a_n") + F.col("b_n") + 2).alias("n_tokens")
    return rounded(preference.truncation_report(counts.select(total)))


@query
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents")
    gaps = docs.select(
        F.col("doc_id").alias(ID),
        F.when(F.col("doc_id") % 23 != 0, F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 29 != 0, F.col("lang")).alias("lang"),
        F.when(F.col("doc_id") % 31 != 0, F.col("n_chars")).alias("n_chars"),
    )
    return cleaning.clean_text(gaps)


@query
def clean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.clean_features(inputs.dirty_features(spark, sf_dir)))


@query
def clean_features_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.clean_features(inputs.dirty_features(spark, sf_dir), policy="null"))


@query
def cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.cleaning_report(inputs.dirty_features(spark, sf_dir))


@query
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = inputs.pair_features(spark, sf_dir)
    cosine = inputs.pairs(spark, sf_dir).select(ID, features.token_cosine().alias("cosine_sim"))
    return rounded(derived.join(cosine, ID))


@query
def feature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features are derived from the texts once and stored; the profile reads the narrow table."""
    path = writers.write_parquet(inputs.pair_features(spark, sf_dir), new_path(spark, "features"))
    stored = readers.read_table(spark, path)
    return profile.column_profile(stored, features.feature_groups(stored), digits=6)


@query
def distill_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _logits(inputs.predictions(spark, sf_dir), "m2")
    return rounded(distill.distill_loss(df, scoring.LOGITS, teacher=MODELS["m1"]))


# ---------------------------------------------------------------- looking at rows


@query
def sample_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = explore.sample_rows(inputs.predictions(spark, sf_dir).select(ID), 10)
    return explore.sample_cards(inputs.pairs(spark, sf_dir, only=drawn))


@query
def guarded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty rows of every group that has that many; smaller groups are left out."""
    known = inputs.predictions(spark, sf_dir)
    groups = {"tie": known.filter("winner_tie = 1"), "key 77": known.filter(f"{ID} % 77 = 0"), "key 7777": known.filter(f"{ID} % 7777 = 0")}
    drawn = {name: explore.sample_or_none(rows.select(ID), 50) for name, rows in groups.items()}
    return alignment.tagged_union({name: df for name, df in drawn.items() if df is not None}, "sampled_from")


@query
def ordered_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows by source order, by fold, and by the wording of a display table."""
    rows = inputs.folded(spark, sf_dir).select(ID, FOLD)
    return alignment.tagged_union(
        {
            "source": explore.in_output_order(rows).limit(100),
            "fold": explore.in_output_order(rows, FOLD, ID).limit(100),
            "head": explore.head_rows(rows, [ID, FOLD]),
        },
        "sorted_by",
    )


@query
def conflict_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _conflicts(spark, sf_dir)
    heads = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias(ID), prefix("text", 200, "...").alias("prompt_head"))
    shown = alignment.align_tables([found, heads])
    return rounded(shown.select(ID, "len_diff", "pred_a", "pred_b", winner_label().alias("winner"), "prompt_head"))


@query
def conflict_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = explore.sample_rows(_conflicts(spark, sf_dir), 3)
    return rounded(drawn.select(ID, "len_diff", "pred_a", "pred_b", winner_label().alias("winner")))


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inputs.lengths(spark, sf_dir)
    narrow = df.select(
        ID,
        *WINNERS,
        (F.col("a_len") - F.col("b_len")).alias("len_diff"),
        F.col("m1_a").alias("pred_a"),
        F.col("m1_b").alias("pred_b"),
    )
    return explore.conflicts(narrow)


# ---------------------------------------------------------------- files


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [f.name for f in PAIR_SCHEMA.fields]
    path = writers.write_csv(inputs.pairs(spark, sf_dir).select(*columns), new_path(spark, "pairs") + ".csv")
    back = readers.fill_text(readers.read_csv(spark, path, PAIR_SCHEMA))
    return back.select(ID, *[F.md5(t).alias(f"{t}_md5") for t in TEXTS], CLUSTER, *WINNERS)


@query
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = preference.preference_triples(inputs.pairs(spark, sf_dir))
    path = writers.write_jsonl(triples, new_path(spark, "triples") + ".jsonl")
    back = readers.read_jsonl(spark, path, PREFERENCE_SCHEMA)
    return back.select(*[F.md5(c).alias(f"{c}_md5") for c in PREFERENCE_SCHEMA.names])


@query
def csv_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A csv whose lines end in CR and LF; the last column is a number."""
    columns = [ID, CLUSTER, *WINNERS]
    path = writers.write_csv(inputs.predictions(spark, sf_dir).select(*columns), new_path(spark, "crlf") + ".csv", line_end="\r\n")
    return readers.read_csv(spark, path, f"{ID} long, {CLUSTER} int, " + ", ".join(f"{w} int" for w in WINNERS))


@query
def csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as large as a task writes them, quoted line breaks and CRLF included, read in byte ranges."""
    columns = [f.name for f in PAIR_SCHEMA.fields]
    path = new_path(spark, "large") + ".csv"
    writers.write_csv(inputs.pairs(spark, sf_dir).select(*columns), path, max_rows_per_file=0, line_end="\r\n")
    back = readers.fill_text(csv_ranges.read_csv_ranges(spark, path, PAIR_SCHEMA))
    return back.select(ID, *[F.md5(t).alias(f"{t}_md5") for t in TEXTS], CLUSTER, *WINNERS)


@query
def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced twice by jobs that read it, the last time through csv; rows and sums of each version, the oldest one expired."""
    root = new_path(spark, "table")
    snapshots.publish(inputs.model_output(inputs.predictions(spark, sf_dir), "m1"), root)
    pinned = snapshots.read_version(spark, root)
    snapshots.publish(pinned.filter(F.col(ID) % 50 != 0), root)
    halved = pinned.withColumn("pred_a", F.col("pred_a") / 2)
    snapshots.publish(halved.unionByName(snapshots.read_version(spark, root)).select(ID, "pred_a"), root, fmt="csv")
    snapshots.expire(spark, root, keep=2)
    left = {n: snapshots.read_version(spark, root, n, None if n < 2 else f"{ID} long, pred_a double") for n in snapshots.versions(spark, root)}
    tables = {n: df.select(ID, "pred_a") for n, df in left.items()}
    total = F.sum(F.round(F.col("pred_a") * 1e6).cast("long")).alias("sum_a")
    return alignment.tagged_union(tables, "version").groupBy("version").agg(F.count(F.lit(1)).alias("n_rows"), total)


@query
def glob_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models' csv outputs through one glob, narrowed by file name."""
    known, root = inputs.predictions(spark, sf_dir), new_path(spark, "outputs")
    for m in MODELS:
        writers.write_csv(inputs.model_output(known, m), f"{root}/{m}.csv")
    found = readers.read_table(spark, f"{root}/m*.csv", OOF_COLUMNS, path_filter="part-*.csv")
    return rounded(found)


@query
def optional_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per output of those that exist; the newest version of each is read, one was never written."""
    known, root = inputs.predictions(spark, sf_dir), new_path(spark, "optional")
    paths = {m: writers.write_new_version(inputs.model_output(known, m), f"{root}/{m}") for m in ("m1", "m2")}
    found = readers.read_available(spark, {**paths, "m3": f"{root}/m3/v-none.parquet"})
    return alignment.row_counts(found)


# ---------------------------------------------------------------- ensembles


@query
def ensemble_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ensemble.ensemble_grid(inputs.predictions(spark, sf_dir), MODELS))


@query
def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ensemble.ensemble_weights(inputs.predictions(spark, sf_dir), MODELS))


@query
def blend_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ensemble.blend_metrics(inputs.predictions(spark, sf_dir), MODELS, BLEND_WEIGHTS))


@query
def fold_softmax_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_fold = metrics.fold_metrics(inputs.folded(spark, sf_dir), MODELS)
    return rounded(metrics.fold_softmax_weights(by_fold).select("model", FOLD, "score", "weight"))


# ---------------------------------------------------------------- logs


@query
def log_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.curve_by_type(curves.parse_logs(inputs.log_lines(spark, sf_dir))))


@query
def log_curves_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readers.read_logs(spark, _log_files(spark, sf_dir), RUN_FOLDER)
    return rounded(curves.curve_by_run(curves.parse_logs(lines)))


@query
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = inputs.with_checkpoints(curves.parse_logs(inputs.log_lines(spark, sf_dir)))
    path = new_path(spark, "states")
    curves.best_checkpoint(evals).select("run", "best_model_checkpoint").write.partitionBy("run").json(path)
    states = readers.read_documents(spark, path)
    name = curves.basename("best_model_checkpoint")
    return states.select("run", name.alias("checkpoint"), curves.checkpoint_step(name).alias("step"))


@query
def resolve_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State documents exist for one model type only; the other runs fall back to their latest checkpoint."""
    evals = inputs.with_checkpoints(curves.parse_logs(inputs.log_lines(spark, sf_dir)))
    path = new_path(spark, "states")
    best = curves.best_checkpoint(evals).filter(F.col("run").startswith("M1"))
    best.select("run", "best_model_checkpoint").write.partitionBy("run").json(path)
    paths = evals.select("run", F.col("checkpoint").alias("path")).distinct()
    return curves.resolve_checkpoint(readers.read_documents(spark, path).select("run", "best_model_checkpoint"), paths)


@query
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    evals = inputs.with_checkpoints(curves.parse_logs(inputs.log_lines(spark, sf_dir)))
    return curves.latest_checkpoint(evals, "checkpoint")


@query
def stream_log_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = jobs.stream_log_curves(spark, _log_files(spark, sf_dir), RUN_FOLDER)
    return rounded(jobs.run_available(stream, "log-curves"))


@query
def stream_fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = inputs.folded(spark, sf_dir).drop("stratify_group")
    path = writers.write_parquet(landed, new_path(spark, "fold-outputs"))
    stream = jobs.stream_fold_metrics(spark, path, landed.schema, MODELS)
    return rounded(jobs.run_available(stream, "fold-metrics"))


#: Rows land in four hours by id; each hour's files repeat a seventh of the hour before, and the last hold rows of a day before.
LANDED = ("2024-01-01 00:00:00", 4, 7, 100)


@query
def stream_fold_metrics_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-fold metrics with repeats within 90 minutes counted once and rows behind the watermark left out, next to how many were late."""
    start, hours, repeats, late = LANDED
    known = readers.read_table(spark, writers.write_parquet(inputs.folded(spark, sf_dir).drop("stratify_group"), new_path(spark, "fold-outputs")))
    path, at = new_path(spark, "landed"), F.lit(start).cast("timestamp")
    out, checkpoint = new_path(spark, "fold-metrics-late-result"), new_path(spark, "fold-metrics-late-checkpoint")
    progress: list[dict] = []
    hour = lambda n: F.make_interval(hours=n)
    for h in range(hours):
        mine = known.where(F.pmod(ID, F.lit(hours)) == h)
        again = known.where((F.pmod(ID, F.lit(hours)) == h - 1) & (F.col(ID) % repeats == 0))
        both = mine.unionByName(again).withColumn("landed", at + hour(F.lit(h)))
        if h + 1 == hours:
            old = known.where(F.col(ID) % late == 0).withColumn(ID, F.col(ID) + 10**9).withColumn("landed", at - hour(F.lit(24)))
            both = both.unionByName(old)
        writers.write_parquet(both, f"{path}/hour={h}")
        stream = jobs.stream_fold_metrics_late(spark, f"{path}/*", both.schema, MODELS, "landed", "90 minutes")
        found = jobs.run_available(stream, "fold-metrics-late", out, checkpoint, progress)  # goes on where the hour before ended
    report = jobs.state_report(spark, progress).where("operator LIKE 'dedup%'").agg(F.sum("late_rows").alias("n_late"))
    return rounded(found.join(F.broadcast(report)).select(*found.columns, "n_late"))


def _log_files(spark: SparkSession, sf_dir: str) -> str:
    lines = inputs.log_lines(spark, sf_dir).select("run", "value")
    return writers.write_lines(lines, new_path(spark, "logs"), partition_by=("run",))


# ---------------------------------------------------------------- learning

#: Bound on the boosting rounds of a preset; a model ends earlier by its patience of 50.
STACK_ROUNDS = 1000
SEARCH_TRIALS = 50
#: Rungs of the registered search; the last is a whole fit.
RUNGS = (10, 30, 90, 270, STACK_ROUNDS)
#: Rungs that the SQL of ``search_contract`` lists.
CONTRACT_RUNGS = (1, 3, 9, 27)
SCORER_INPUTS = ("m1_a", "m1_b", "m2_a")


def scorer_coefficient(fold: int, cls: int, i: int) -> float:
    return ((fold * 7 + cls * 3 + i * 5) % 11 - 5) / 10


def _coefficients() -> dict[int, list[list[float]]]:
    terms = range(len(SCORER_INPUTS) + 1)
    return {k: [[scorer_coefficient(k, c, i) for i in terms] for c in range(3)] for k in range(N_FOLDS)}


@query
def oof_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score_folds(inputs.folded(spark, sf_dir), scoring.linear_models(_coefficients()), SCORER_INPUTS)
    return rounded(scoring.oof_predictions(scored))


@query
def oof_score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rendered prompts scored by the model of their fold, in length ranges that are published one by one."""
    prompts = preference.rendered(inputs.pairs(spark, sf_dir), "judge").join(inputs.folded(spark, sf_dir).select(ID, FOLD), ID)
    stored = readers.read_table(spark, writers.write_parquet(prompts, new_path(spark, "prompts") + ".parquet"))
    scored = scoring.score_texts(stored, new_path(spark, "scores"), scoring.text_models(_coefficients()))
    return rounded(scoring.oof_predictions(scored))


def _boost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features derived from the texts, the cluster encoded by the other folds, and two models' probabilities, with folds by target."""
    stored = writers.write_parquet(inputs.pair_features(spark, sf_dir), new_path(spark, "features"))
    clean = cleaning.clean_features(readers.read_table(spark, stored), policy="null")
    known = inputs.predictions(spark, sf_dir)
    assigned = folds.assign_folds(known.select(ID, *WINNERS), folds.stratum_by_target()).select(ID, FOLD)
    outputs = {f"x{m}": inputs.model_output(known, m) for m in ("m1", "m2")}
    table = alignment.align_models(alignment.align_tables([clean, assigned]), outputs)
    return encoding.fold_encoding(table, categorical_columns(feature_columns(table)))


_STORED: dict[tuple, str] = {}


def _once(spark: SparkSession, what: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of a session read, computed and written by the first of them."""
    key = (spark.sparkContext.applicationId, *what)
    if key not in _STORED:
        _STORED[key] = writers.write_parquet(make(), new_path(spark, "stored"))
    return spark.read.parquet(_STORED[key])


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, ("training", sf_dir), lambda: _boost_table(spark, sf_dir))


def _boosted(spark: SparkSession, sf_dir: str, rounds: int) -> DataFrame:
    """The saved node tables of both presets, one model per fold."""

    def fit() -> DataFrame:
        table = _training(spark, sf_dir)
        fleet = boosting.Fleet(spark, boosting.bin_table(table, feature_columns(table)), boosting.fold_members(boosting.PRESETS))
        try:
            return fleet.run(rounds).nodes()
        finally:
            fleet.close()

    return _once(spark, ("boosted", sf_dir, rounds), fit)


def _level2(spark: SparkSession, sf_dir: str, rounds: int) -> dict[str, DataFrame]:
    table, models = _training(spark, sf_dir), _boosted(spark, sf_dir, rounds)
    return {preset: boosting.predict(table, models, preset, feature_columns(table)).select(*PREDS, ID) for preset in boosting.PRESETS}


@query
def stack_oof(spark: SparkSession, sf_dir: str, rounds: int = STACK_ROUNDS) -> DataFrame:
    """Both boosting presets: one multi-class model per fold, saved, and each row scored by the model that never saw it.

    A model stops 50 rounds after its best one; ``rounds`` bounds them (see ``STACK_ROUNDS``).
    """
    return rounded(alignment.tagged_union(_level2(spark, sf_dir, rounds), "variant"))


@query
def stack_oof_contract(spark: SparkSession, sf_dir: str, rounds: int = STACK_ROUNDS) -> DataFrame:
    """What level-2 predictions of each preset must hold: every row once, probabilities that sum to 1, a loss below a guess and below the better
    of the two models they are stacked on."""
    known = inputs.predictions(spark, sf_dir)
    checks = {}
    for preset, oof in _level2(spark, sf_dir, rounds).items():
        joined = alignment.backfill(known.select(ID, *WINNERS, *MODELS["m1"], *MODELS["m2"]), oof, list(PREDS))
        total = F.col("pred_a") + F.col("pred_b") + F.col("pred_tie")
        loss = F.avg(one_hot_loss(PREDS))
        checks[preset] = joined.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(ID).alias("n_ids"),
            F.count_if(F.col("pred_a").isNull()).alias("n_missing"),
            F.count_if(F.abs(total - 1) < 1e-9).alias("n_sum_one"),
            (loss < math.log(3)).alias("better_than_guess"),
            (loss < F.least(F.avg(one_hot_loss(MODELS["m1"])), F.avg(one_hot_loss(MODELS["m2"])))).alias("better_than_inputs"),
        )
    return alignment.tagged_union(checks, "variant")


@query
def stack_blend(spark: SparkSession, sf_dir: str, rounds: int = STACK_ROUNDS) -> DataFrame:
    """What the best blend of both presets' level-2 predictions and a level-1 model must hold: weights on the simplex, a loss no worse than any alone."""
    known = inputs.predictions(spark, sf_dir).select(ID, *WINNERS, *MODELS["m1"])
    names = {"m1": MODELS["m1"]}
    for preset, oof in _level2(spark, sf_dir, rounds).items():
        names[preset] = tuple(f"{preset}_{s}" for s in ("a", "b", "tie"))
        known = known.join(oof.withColumnsRenamed(dict(zip(PREDS, names[preset]))), ID)
    fit = ensemble.fit_blend(known, names)
    weights = [float(fit.weights[m]) for m in names]
    alone = metrics.model_metrics(known, names).agg(F.min("log_loss").alias("least"))
    return alone.select(
        F.lit(len(weights)).cast("bigint").alias("n_models"),
        F.lit(abs(sum(weights) - 1) < 1e-9 and min(weights) >= 0).alias("on_simplex"),
        (F.lit(float(fit.log_loss)) <= F.col("least") + 1e-9).alias("no_worse"),
    )


def _searched(spark: SparkSession, sf_dir: str, trials: int, rungs: tuple[int, ...]) -> DataFrame:
    def search() -> DataFrame:
        table = _training(spark, sf_dir)
        return boosting.halving(spark, boosting.bin_table(table, feature_columns(table)), boosting.SEARCH_SPACES, boosting.PRESETS, trials, rungs)

    return _once(spark, ("search", sf_dir, trials, rungs), search)


@query
def tune_stacker(spark: SparkSession, sf_dir: str, trials: int = SEARCH_TRIALS, rungs: tuple[int, ...] = RUNGS) -> DataFrame:
    """Successive halving over both boosted spaces: every trial with the losses of the rungs it reached, the best of each space first.

    Trials that reach the last rung have the rounds of a whole fit, or end by a patience of 50.
    """
    found = _searched(spark, sf_dir, trials, rungs)
    return rounded(found).orderBy("space", F.desc("rung"), "mean_log_loss", "trial")


@query
def search_contract(spark: SparkSession, sf_dir: str, trials: int = SEARCH_TRIALS, rungs: tuple[int, ...] = CONTRACT_RUNGS) -> DataFrame:
    """What the search must hold for each space and rung: the trials promoted to it, all of them no worse than those left behind or than before."""
    found = _searched(spark, sf_dir, trials, rungs)
    before = found.select("space", "trial", (F.col("rung") + 1).alias("rung"), F.col("mean_log_loss").alias("was"), F.col("promoted").alias("sent"))
    both = found.join(before, ["space", "trial", "rung"], "left")
    lost = F.max(F.when(F.col("promoted"), F.col("mean_log_loss"))) <= F.min(F.when(~F.col("promoted"), F.col("mean_log_loss")))
    return both.groupBy("space", "rung").agg(
        F.count_distinct("trial").alias("n_trials"),
        F.max("rounds").cast("bigint").alias("rounds"),
        F.count_if("promoted").alias("n_promoted"),
        F.count_if((F.col("rung") > 0) & ~F.coalesce("sent", F.lit(False))).alias("n_not_promoted_before"),
        F.count_if(F.col("mean_log_loss") > F.col("was")).alias("n_worse_than_before"),
        F.coalesce(lost, F.lit(True)).alias("best_go_on"),
    )


@query
def feature_importance(spark: SparkSession, sf_dir: str, rounds: int = STACK_ROUNDS) -> DataFrame:
    """The ten features of the largest gain, averaged over the fold models of each preset; the depthwise one counts only folds that use a feature."""
    return rounded(boosting.mean_gain(_gains(spark, sf_dir, rounds), 10))


def _gains(spark: SparkSession, sf_dir: str, rounds: int) -> DataFrame:
    models, features = _boosted(spark, sf_dir, rounds), feature_columns(_training(spark, sf_dir))
    leafwise = boosting.gain_importance(models.where("model = 'leafwise'"), features)
    return leafwise.unionByName(boosting.gain_importance(models.where("model = 'depthwise'"), features, "skip"))


@query
def importance_contract(spark: SparkSession, sf_dir: str, rounds: int = STACK_ROUNDS) -> DataFrame:
    """What importances must hold: all features of all folds (where features without a split count), no negative gain, and the gain of all splits."""
    models, per_fold = _boosted(spark, sf_dir, rounds), _gains(spark, sf_dir, rounds)
    gains = models.where("feature IS NOT NULL").groupBy("model").agg(F.sum("gain").alias("whole"))
    seen = per_fold.groupBy("model").agg(
        F.count_distinct("fold").alias("n_folds"),
        F.when(F.col("model") == "leafwise", F.count_distinct("feature")).otherwise(0).alias("n_features"),
        F.count_if(F.col("importance") < 0).alias("n_negative"),
        F.sum("importance").alias("total"),
    )
    return seen.join(gains, "model").select("model", "n_folds", "n_features", "n_negative", (F.abs(F.col("total") / F.col("whole") - 1) < 1e-9).alias("sums_up"))


@query
def fold_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class frequencies of every row's cluster in the other folds."""
    known = inputs.predictions(spark, sf_dir).select(ID, CLUSTER, *WINNERS)
    assigned = folds.assign_folds(known, folds.stratum_by_target())
    return rounded(encoding.fold_encoding(assigned, [CLUSTER]).select(ID, *[f"{CLUSTER}__{s}" for s in encoding.SUFFIXES]))
