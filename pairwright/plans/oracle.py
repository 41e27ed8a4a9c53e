"""SQL for every query that SQL can express, written independently of the operators.

Common table expressions are named once in ``_CTES``; ``sql`` puts in front of a query those it needs.
"""

from __future__ import annotations

import re

from pairwright.functions.text import JUDGE_TEMPLATE, SHORT_JUDGE_TEMPLATE
from pairwright.operators.features import FLAG_PATTERNS, RESPONSE_FLAGS
from pairwright.plans.catalog import BLEND_WEIGHTS, SCORER_INPUTS, TABLES, scorer_coefficient
from pairwright.plans.inputs import HINTS, NOISE
from pairwright.schema import N_FOLDS

_MODELS = ("m1", "m2", "m3")
_SIDES = ("a", "b", "tie")
_SPACE = "[ \\t\\n\\r\\f]+"
_WORD = "[^ \\t\\n\\r\\f]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ---------------------------------------------------------------- shared expressions

_CTES: dict[str, str] = {}

_hint_cols = ", ".join(
    f"CASE WHEN id % {mod} < {below} THEN (y + {shift}) % 3 ELSE y END AS h_{m}" for m, (mod, below, shift) in HINTS.items()
)
_weight_cols = ", ".join(
    f"CAST(1 + (id * {mul} + {add}) % {mod} + CASE WHEN h_{m} = {c} THEN 150 ELSE 0 END AS DOUBLE) AS w_{m}_{_SIDES[c]}"
    for m, noise in NOISE.items()
    for c, (mul, add, mod) in enumerate(noise)
)
_prob_cols = ", ".join(f"w_{m}_{s} / (w_{m}_a + w_{m}_b + w_{m}_tie) AS {m}_{s}" for m in _MODELS for s in _SIDES)

_CTES["base"] = """SELECT doc_id AS id, TRY_CAST(SUBSTRING(source, 4) AS INTEGER) AS cluster_id_k20,
  CASE WHEN (doc_id * 7919 + 104729) % 1000 < 350 THEN 0 WHEN (doc_id * 7919 + 104729) % 1000 < 690 THEN 1 ELSE 2 END AS y
  FROM documents"""
_CTES["weighted"] = f"SELECT *, {_weight_cols} FROM (SELECT *, {_hint_cols} FROM base)"
_CTES["pred"] = f"""SELECT id, cluster_id_k20, y, CASE WHEN y = 0 THEN 1 ELSE 0 END AS winner_model_a,
  CASE WHEN y = 1 THEN 1 ELSE 0 END AS winner_model_b, CASE WHEN y = 2 THEN 1 ELSE 0 END AS winner_tie, {_prob_cols} FROM weighted"""
_CTES["long"] = " UNION ALL ".join(
    f"""SELECT id, cluster_id_k20, y, '{m}' AS model, {m}_a AS pa, {m}_b AS pb, {m}_tie AS pt,
  CASE y WHEN 0 THEN {m}_a WHEN 1 THEN {m}_b ELSE {m}_tie END AS pq FROM pred"""
    for m in _MODELS
)
_CTES["scored"] = """SELECT *, -LN(LEAST(GREATEST(pq, 1e-15), 1 - 1e-15)) AS loss,
  CASE WHEN pa >= pb AND pa >= pt THEN 0 WHEN pb >= pt THEN 1 ELSE 2 END AS c FROM long"""
_CTES["stratum"] = """SELECT *, COALESCE(CAST(cluster_id_k20 AS VARCHAR), 'nan') || '_' ||
  CASE y WHEN 0 THEN 'winner_model_a' WHEN 1 THEN 'winner_model_b' ELSE 'winner_tie' END AS stratify_group FROM pred"""
_FOLD = "CAST((ROW_NUMBER() OVER (ORDER BY md5({g}), {g}, md5(CAST(id AS VARCHAR) || ':42'), id) - 1) % 5 AS INTEGER) AS fold"
_CTES["folds"] = f"SELECT *, {_FOLD.format(g='stratify_group')} FROM stratum"
_CTES["by_fold"] = """SELECT f.fold, s.model, COUNT(*) AS n, AVG(s.loss) AS log_loss,
  AVG(CASE WHEN s.c = s.y THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM scored s JOIN folds f ON f.id = s.id GROUP BY f.fold, s.model"""
_CTES["oof"] = """SELECT id, m1_a AS pred_a, m1_b AS pred_b, m1_tie AS pred_tie FROM pred WHERE id % 50 <> 0
  UNION ALL SELECT id, m1_a, m1_b, m1_tie FROM pred WHERE id % 97 = 0 AND id % 50 <> 0
  UNION ALL SELECT id + 1000000, m1_a, m1_b, m1_tie FROM pred WHERE id % 89 = 0"""
_CTES["n_docs"] = "SELECT COUNT(*) AS n FROM documents"
_CTES["roles"] = """SELECT doc_id AS p_id, ((doc_id - 1) % n + n) % n AS a_for, ((doc_id - 7) % n + n) % n AS b_for, text
  FROM documents, n_docs"""
_CTES["texts"] = """SELECT p.p_id AS id, p.text AS p_text, a.text AS a_text, b.text AS b_text
  FROM roles p JOIN roles a ON a.a_for = p.p_id JOIN roles b ON b.b_for = p.p_id"""
_CTES["pairs"] = "SELECT t.p_text, t.a_text, t.b_text, p.* FROM texts t JOIN pred p ON p.id = t.id"
_CTES["lengths"] = """SELECT p.*, CAST(LENGTH(p_text) AS BIGINT) AS p_len, CAST(LENGTH(a_text) AS BIGINT) AS a_len,
  CAST(LENGTH(b_text) AS BIGINT) AS b_len FROM pairs p"""
_CTES["dirty"] = """SELECT id, CASE WHEN id % 37 <> 0 THEN cluster_id_k20 END AS cluster_id_k20, CAST(p_len AS DOUBLE) AS len_p, CAST(a_len - b_len AS DOUBLE) AS len_diff,
  CASE WHEN id % 11 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN id % 13 = 0 THEN CAST('-Infinity' AS DOUBLE)
       WHEN id % 17 = 0 THEN CAST('NaN' AS DOUBLE) WHEN id % 19 = 0 THEN CAST(NULL AS DOUBLE)
       ELSE CAST(a_len AS DOUBLE) / (b_len + 1) END AS len_ratio,
  CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS is_code_task, winner_model_a, winner_model_b, winner_tie FROM lengths"""
_CTES["worst"] = """SELECT id, cluster_id_k20, winner_model_a, winner_model_b, m1_a, m1_b, m1_tie, sample_loss FROM (
  SELECT p.*, ROUND(s.loss, 6) AS sample_loss FROM scored s JOIN pred p ON p.id = s.id WHERE s.model = 'm1')
  ORDER BY sample_loss DESC, id LIMIT 50"""
_CTES["conflicts"] = """SELECT id, a_len - b_len AS len_diff, m1_a AS pred_a, m1_b AS pred_b, p_text,
  CASE y WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'Tie' END AS winner FROM lengths WHERE a_len - b_len > 500 AND m1_b > m1_a"""

_measure_cols = ", ".join(
    f"COALESCE(CAST(regexp_matches(chr(10) || t, {_text(p)}) AS INTEGER), 0) AS {name}"
    for name, p in FLAG_PATTERNS.items()
)
_CTES["measures"] = f"""SELECT *, CASE WHEN words > 0 THEN letters / words ELSE 0.0 END AS word_len FROM (
  SELECT p_id, a_for, b_for, LENGTH(t) AS len, CAST(LEN(regexp_extract_all(t, '{_WORD}')) AS DOUBLE) AS words,
  CAST(LENGTH(regexp_replace(t, '{_SPACE}', '', 'g')) AS DOUBLE) AS letters, {_measure_cols}
  FROM (SELECT *, COALESCE(text, '') AS t FROM roles))"""
_flag_cols = ", ".join(f"{s}.{flag} AS {flag}_{s}" for flag in RESPONSE_FLAGS for s in ("a", "b"))
_CTES["features"] = f"""SELECT *, len_a - len_b AS len_diff, len_a / (len_b + 1) AS len_ratio, len_a / (len_p + 1) AS expansion_a,
  len_b / (len_p + 1) AS expansion_b, len_a / (len_p + 1) - len_b / (len_p + 1) AS expansion_diff,
  (len_a - len_b) * is_code_task AS len_diff_x_is_code_task, len_a / (len_b + 1) * read_diff AS len_ratio_x_read_diff FROM (
  SELECT p.p_id AS id, q.cluster_id_k20, q.winner_model_a, q.winner_model_b, q.winner_tie, CAST(p.len AS DOUBLE) AS len_p,
  CAST(a.len AS DOUBLE) AS len_a, CAST(b.len AS DOUBLE) AS len_b, a.word_len - b.word_len AS read_diff, {_flag_cols}, p.is_code_task
  FROM measures p JOIN measures a ON a.a_for = p.p_id JOIN measures b ON b.b_for = p.p_id JOIN pred q ON q.id = p.p_id)"""
_CTES["tokens"] = f"""SELECT id, side, tok, COUNT(*) AS c FROM (
  SELECT id, 'a' AS side, UNNEST(string_split_regex(COALESCE(a_text, ''), '{_SPACE}')) AS tok FROM texts UNION ALL
  SELECT id, 'b', UNNEST(string_split_regex(COALESCE(b_text, ''), '{_SPACE}')) FROM texts) WHERE tok <> '' GROUP BY id, side, tok"""
_CTES["norms"] = "SELECT id, side, SUM(CAST(c * c AS DOUBLE)) AS ss FROM tokens GROUP BY id, side"
_CTES["dots"] = """SELECT a.id, SUM(CAST(a.c * b.c AS DOUBLE)) AS ab FROM tokens a JOIN tokens b
  ON b.id = a.id AND b.tok = a.tok WHERE a.side = 'a' AND b.side = 'b' GROUP BY a.id"""
_CTES["cosine"] = """SELECT t.id, COALESCE(d.ab / (SQRT(x.ss) * SQRT(z.ss)), 0.0) AS cosine_sim FROM texts t
  LEFT JOIN dots d ON d.id = t.id LEFT JOIN norms x ON x.id = t.id AND x.side = 'a'
  LEFT JOIN norms z ON z.id = t.id AND z.side = 'b'"""

_CTES["log_lines"] = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'M1' ELSE 'M2' END || '_Fold' ||
  CAST(CAST(FLOOR(event_id / 2.0) AS BIGINT) % 5 AS VARCHAR) AS run,
  CAST(FLOOR(event_id / 10.0) AS BIGINT) % 20 AS k, (event_id * 17) % 100 AS r,
  CAST(FLOOR(event_id / 10.0) AS BIGINT) % 3 AS kind FROM events"""
_CTES["records"] = """SELECT run, SPLIT_PART(run, '_', 1) AS model_type, CASE WHEN kind = 0 THEN 'eval' ELSE 'train' END AS kind,
  CAST(k AS DOUBLE) / 10 AS epoch, CAST(1100 - 20 * k + r AS DOUBLE) / 1000 AS loss, k
  FROM log_lines WHERE event_id % 13 <> 0 AND event_id % 17 <> 0"""


def sql(query: str, recursive: str = "") -> str:
    """The query with the common table expressions it needs, in order of definition."""
    needed: set[str] = set()
    pending = [query, recursive]
    while pending:
        words = set(re.findall(r"[a-z_0-9]+", pending.pop()))
        for name in _CTES.keys() & words - needed:
            needed.add(name)
            pending.append(_CTES[name])
    parts = [f"{name} AS ({body})" for name, body in _CTES.items() if name in needed]
    if recursive:
        parts.append(recursive)
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" if parts else ""
    return head + query


ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- evaluation

ORACLE["model_metrics"] = sql(
    """SELECT model, COUNT(*) AS n, ROUND(AVG(loss), 6) AS log_loss,
  ROUND(AVG(CASE WHEN c = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored GROUP BY model"""
)
_classes = ", ".join(
    f"CASE WHEN {m}_a >= {m}_b AND {m}_a >= {m}_tie THEN 0 WHEN {m}_b >= {m}_tie THEN 1 ELSE 2 END AS {m}_class" for m in _MODELS
)
ORACLE["class_labels"] = sql(f"SELECT id, y, {_classes} FROM pred")
ORACLE["sample_loss"] = sql(
    "SELECT id, "
    + ", ".join(f"ROUND(MAX(CASE WHEN model = '{m}' THEN loss END), 6) AS {m}_loss" for m in _MODELS)
    + " FROM scored GROUP BY id"
)
ORACLE["fold_metrics"] = sql("SELECT fold, model, n, ROUND(log_loss, 6) AS log_loss, ROUND(accuracy, 6) AS accuracy FROM by_fold")
ORACLE["cv_mean_of_folds"] = sql(
    """SELECT model, COUNT(*) AS n_folds, ROUND(AVG(log_loss), 6) AS mean_log_loss, ROUND(AVG(accuracy), 6) AS mean_accuracy
  FROM by_fold GROUP BY model"""
)
ORACLE["cluster_loss"] = sql(
    "SELECT cluster_id_k20, COUNT(DISTINCT id) AS n, "
    + ", ".join(f"ROUND(AVG(CASE WHEN model = '{m}' THEN loss END), 6) AS {m}_loss" for m in _MODELS)
    + ", "
    + ", ".join(f"(SELECT ROUND(AVG(loss), 6) FROM scored WHERE model = '{m}') AS {m}_overall" for m in _MODELS)
    + " FROM scored GROUP BY cluster_id_k20"
)
_CTES["cells"] = """SELECT m.model, CAST(t.t AS INTEGER) AS true_class, CAST(q.q AS INTEGER) AS pred_class,
  (SELECT COUNT(*) FROM scored s WHERE s.model = m.model AND s.y = t.t AND s.c = q.q) AS n
  FROM (SELECT DISTINCT model FROM scored) m, (SELECT UNNEST([0, 1, 2]) AS t) t, (SELECT UNNEST([0, 1, 2]) AS q) q"""
ORACLE["confusion_matrix"] = sql(
    """SELECT model, true_class, pred_class, n,
  ROUND(COALESCE(n / NULLIF(CAST(SUM(n) OVER (PARTITION BY model, true_class) AS DOUBLE), 0), 0.0), 6) AS share FROM cells"""
)
ORACLE["class_report"] = sql(
    """SELECT model, k AS class, ROUND(COALESCE(hit / NULLIF(predicted, 0), 0), 6) AS precision,
  ROUND(COALESCE(hit / NULLIF(actual, 0), 0), 6) AS recall, ROUND(COALESCE(2 * hit / NULLIF(predicted + actual, 0), 0), 6) AS f1,
  CAST(actual AS BIGINT) AS support FROM (
  SELECT model, CAST(k AS INTEGER) AS k, CAST(SUM(CASE WHEN true_class = k AND pred_class = k THEN n ELSE 0 END) AS DOUBLE) AS hit,
  CAST(SUM(CASE WHEN pred_class = k THEN n ELSE 0 END) AS DOUBLE) AS predicted,
  CAST(SUM(CASE WHEN true_class = k THEN n ELSE 0 END) AS DOUBLE) AS actual
  FROM cells, (SELECT UNNEST([0, 1, 2]) AS k) GROUP BY model, k)"""
)


def _softmax(cols: list[str]) -> list[str]:
    total = " + ".join(f"EXP({c})" for c in cols)
    return [f"EXP({c}) / ({total})" for c in cols]


_soft = _softmax([f"4 * m1_{s}" for s in _SIDES])
ORACLE["softmax_probs"] = sql("SELECT id, " + ", ".join(f"ROUND({e}, 6) AS pred_{s}" for e, s in zip(_soft, _SIDES)) + " FROM pred")
ORACLE["logit_metrics"] = sql(
    """SELECT model, COUNT(*) AS n, ROUND(AVG(-LN(EXP(3 * pq) / (EXP(3 * pa) + EXP(3 * pb) + EXP(3 * pt)))), 6) AS log_loss,
  ROUND(AVG(CASE WHEN c = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored GROUP BY model"""
)
ORACLE["confidence_density"] = sql(
    """SELECT model, CAST(point AS INTEGER) AS point, ROUND(x, 6) AS x,
  ROUND(SUM(n * EXP(-0.5 * POWER((x - centre) / bw, 2))) / (ANY_VALUE(n_all) * ANY_VALUE(bw) * SQRT(2 * PI())), 6) AS density
  FROM (SELECT b.model, b.n, b.centre, g.point, s.bw, s.n_all, s.lo - 3 * s.bw + (s.hi - s.lo + 6 * s.bw) / 199 * g.point AS x
    FROM (SELECT model, FLOOR(pa * 10000) AS bin, COUNT(*) AS n, AVG(pa) AS centre FROM long GROUP BY 1, 2) b
    JOIN (SELECT model, COUNT(*) AS n_all, MIN(pa) AS lo, MAX(pa) AS hi, STDDEV_SAMP(pa) * POWER(COUNT(*), -0.2) AS bw
          FROM long GROUP BY model) s ON s.model = b.model, (SELECT UNNEST(RANGE(200)) AS point) g)
  GROUP BY model, point, x"""
)
ORACLE["bad_cases"] = sql("SELECT id, cluster_id_k20, sample_loss FROM worst")
ORACLE["bad_case_clusters"] = sql("SELECT cluster_id_k20, COUNT(*) AS n FROM worst GROUP BY cluster_id_k20")
ORACLE["bad_case_cards"] = sql(
    """SELECT w.id, ROUND(sample_loss, 4) AS sample_loss, cluster_id_k20, SUBSTRING(d.text, 1, 200) || '...' AS prompt_head,
  CASE WHEN winner_model_a = 1 THEN 'A' WHEN winner_model_b = 1 THEN 'B' ELSE 'Tie' END AS winner,
  ROUND(m1_a, 2) AS show_a, ROUND(m1_b, 2) AS show_b, ROUND(m1_tie, 2) AS show_tie
  FROM (SELECT * FROM worst ORDER BY sample_loss DESC, id LIMIT 3) w JOIN documents d ON d.doc_id = w.id"""
)

# ---------------------------------------------------------------- folds

ORACLE["stratified_folds"] = sql("SELECT id, stratify_group, fold FROM folds")
ORACLE["stratified_folds_target"] = sql(
    f"SELECT id, target, {_FOLD.format(g='target')} FROM (SELECT id, CAST(y AS VARCHAR) AS target FROM pred)"
)
ORACLE["fold_counts"] = sql("SELECT fold, COUNT(*) AS n FROM folds GROUP BY fold")
ORACLE["fold_balance"] = sql(
    """SELECT stratify_group, CAST(SUM(c) AS BIGINT) AS n, MIN(c) AS min_fold, MAX(c) AS max_fold, MAX(c) - MIN(c) AS spread
  FROM (SELECT g.stratify_group, k.k, COUNT(f.id) AS c FROM (SELECT DISTINCT stratify_group FROM folds) g
    CROSS JOIN (SELECT UNNEST(RANGE(5)) AS k) k LEFT JOIN folds f ON f.stratify_group = g.stratify_group AND f.fold = k.k
    GROUP BY g.stratify_group, k.k) GROUP BY stratify_group"""
)
ORACLE["split_counts"] = sql(
    """SELECT CAST(k AS INTEGER) AS fold, COUNT(*) FILTER (WHERE f.fold <> k) AS n_train, COUNT(*) FILTER (WHERE f.fold = k) AS n_valid
  FROM folds f, (SELECT UNNEST(RANGE(5)) AS k) GROUP BY k"""
)

# ---------------------------------------------------------------- alignment

ORACLE["align_models"] = sql(
    "SELECT id, cluster_id_k20, "
    + ", ".join(f"ROUND({m}_{s}, 6) AS x{m}_{s}" for m in _MODELS for s in _SIDES)
    + " FROM pred"
)
ORACLE["alignment_audit"] = sql(
    """SELECT (SELECT COUNT(*) FROM pred) AS left_rows, (SELECT COUNT(*) FROM oof) AS right_rows,
  COUNT(*) FILTER (WHERE l.id IS NOT NULL AND r.id IS NOT NULL) AS matched_keys, COUNT(*) FILTER (WHERE r.id IS NULL) AS left_only_keys,
  COUNT(*) FILTER (WHERE l.id IS NULL) AS right_only_keys, COUNT(*) FILTER (WHERE l.c > 1) AS left_repeated_keys,
  COUNT(*) FILTER (WHERE r.c > 1) AS right_repeated_keys
  FROM (SELECT id, COUNT(*) AS c FROM pred GROUP BY id) l FULL OUTER JOIN (SELECT id, COUNT(*) AS c FROM oof GROUP BY id) r ON r.id = l.id"""
)
ORACLE["label_backfill"] = sql(
    """SELECT o.id, ROUND(pred_a, 6) AS pred_a, ROUND(pred_b, 6) AS pred_b, ROUND(pred_tie, 6) AS pred_tie, p.cluster_id_k20,
  p.winner_model_a, p.winner_model_b, p.winner_tie FROM oof o LEFT JOIN pred p ON p.id = o.id"""
)
ORACLE["oof_completeness"] = sql(
    """SELECT *, n_rows > 0 AND n_rows = n_scored AS complete FROM (
  SELECT f.fold, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE o.c = 1) AS n_scored, COUNT(*) FILTER (WHERE o.c IS NULL) AS n_missing,
  COUNT(*) FILTER (WHERE o.c > 1) AS n_repeated FROM folds f
  LEFT JOIN (SELECT id, COUNT(*) AS c FROM oof GROUP BY id) o ON o.id = f.id GROUP BY f.fold)"""
)
ORACLE["winner_audit"] = sql(
    """SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE w = 1) AS n_valid, COUNT(*) FILTER (WHERE w <> 1) AS n_invalid FROM (
  SELECT CASE WHEN id % 43 = 0 THEN 0 ELSE winner_model_a END + winner_model_b + CASE WHEN id % 41 = 0 THEN 1 ELSE winner_tie END AS w
  FROM pred)"""
)
ORACLE["row_counts"] = " UNION ALL ".join(f"SELECT '{t}' AS source, COUNT(*) AS n_rows FROM {t}" for t in TABLES)
ORACLE["teacher_join"] = sql(
    "SELECT id, fold, y AS labels, "
    + ", ".join(f"ROUND(m3_{s}, 6) AS teacher_{s}" for s in _SIDES)
    + ", 3 AS n_probs, "
    + ", ".join(f"ROUND(m3_{s}, 6) AS teacher_prob_{i}" for i, s in enumerate(_SIDES))
    + " FROM folds"
)

ORACLE["backfilled_metrics"] = sql(
    """SELECT 'oof' AS model, COUNT(*) AS n, ROUND(AVG(-LN(CASE y WHEN 0 THEN pred_a WHEN 1 THEN pred_b ELSE pred_tie END)), 6) AS log_loss,
  ROUND(AVG(CASE WHEN y = CASE WHEN pred_a >= pred_b AND pred_a >= pred_tie THEN 0 WHEN pred_b >= pred_tie THEN 1 ELSE 2 END
    THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM oof o JOIN pred p ON p.id = o.id WHERE o.id % 29 <> 0 AND o.id % 31 <> 0"""
)
ORACLE["row_balance"] = sql(
    """SELECT 'assign_folds' AS operator, COUNT(*) AS rows_in, COUNT(*) AS rows_out, CAST(0 AS BIGINT) AS rows_reported FROM pred UNION ALL
  SELECT name, COUNT(*), COUNT(*) FILTER (WHERE id % 17 <> 0), COUNT(*) FILTER (WHERE id % 17 = 0)
  FROM pred, (SELECT UNNEST(['score_folds', 'fold_metrics']) AS name) GROUP BY name"""
)

# ---------------------------------------------------------------- preparation

ORACLE["dpo_pairs"] = sql(
    """SELECT id, p_text AS prompt, CASE WHEN y = 0 THEN a_text ELSE b_text END AS chosen,
  CASE WHEN y = 0 THEN b_text ELSE a_text END AS rejected FROM pairs WHERE y <> 2"""
)
ORACLE["render_concat"] = sql("SELECT id, p_text || ' [SEP] ' || a_text || ' [SEP] ' || b_text AS text FROM pairs")


def _fill(template: str, fields: dict[str, str]) -> str:
    out = _text(template)
    for name, expression in fields.items():
        out = out.replace("{" + name + "}", f"' || {expression} || '")
    return out


_SHORT = _fill(SHORT_JUDGE_TEMPLATE, {s: f"SUBSTRING({s}_text, 1, 1200)" for s in ("p", "a", "b")})
ORACLE["render_prompt"] = sql(f"SELECT id, {_fill(JUDGE_TEMPLATE, {s: f'{s}_text' for s in ('p', 'a', 'b')})} AS text FROM pairs")
ORACLE["render_prompt_short"] = sql(f"SELECT id, {_SHORT} AS text FROM pairs")


def _tokens(source: str, text: str, key: str) -> str:
    """(key, tok, pos) of the words of a text."""
    return f"""SELECT {key}, tok, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY i) AS pos FROM (
    SELECT {key}, UNNEST(parts) AS tok, GENERATE_SUBSCRIPTS(parts, 1) AS i FROM (
      SELECT {key}, string_split_regex({text}, '{_SPACE}') AS parts FROM {source})) WHERE tok <> ''"""


_KNOWN = """SELECT tok, n, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, tok) AS INTEGER) AS token_id
  FROM (SELECT tok, COUNT(*) AS n FROM {} GROUP BY tok) QUALIFY token_id <= 2000"""
_CTES["short_toks"] = _tokens("pairs", _SHORT, "id")
_CTES["short_known"] = _KNOWN.format("short_toks")
_CTES["doc_toks"] = _tokens("documents", "COALESCE(text, '')", "doc_id")
_CTES["doc_known"] = _KNOWN.format("doc_toks")
ORACLE["vocabulary"] = sql("SELECT tok AS token, n, token_id FROM doc_known")
ORACLE["pretokenize"] = sql(
    """SELECT id, CAST(MAX(pos) AS INTEGER) AS n_tokens, CAST(LEAST(MAX(pos), 2048) AS INTEGER) AS n_kept,
  CAST(COUNT(*) FILTER (WHERE k.token_id IS NULL) AS INTEGER) AS n_unknown,
  md5(STRING_AGG(CAST(COALESCE(k.token_id, 0) AS VARCHAR), ' ' ORDER BY pos) FILTER (WHERE pos <= 2048)) AS ids_md5
  FROM short_toks t LEFT JOIN short_known k ON k.tok = t.tok GROUP BY id"""
)
ORACLE["batched_tokens"] = sql(
    """SELECT d.doc_id, CAST(COALESCE(n, 0) AS INTEGER) AS n_tokens, CAST(LEAST(COALESCE(n, 0), 64) AS INTEGER) AS n_kept,
  CAST(COALESCE(s, 0) AS INTEGER) AS sum_ids FROM documents d LEFT JOIN (
    SELECT doc_id, MAX(pos) AS n, SUM(LENGTH(tok)) FILTER (WHERE pos <= 64) AS s FROM doc_toks GROUP BY doc_id) t ON t.doc_id = d.doc_id"""
)
_CTES["lens"] = f"""SELECT p_id, a_for, b_for, LEN(regexp_extract_all(COALESCE(text, ''), '{_WORD}')) AS n FROM roles"""
ORACLE["truncation_report"] = sql(
    """SELECT CAST(cap AS INTEGER) AS max_len, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE n > cap) AS n_cut,
  ROUND(AVG(CASE WHEN n > cap THEN 1.0 ELSE 0.0 END), 6) AS share_cut, ROUND(AVG(CAST(LEAST(n, cap) AS DOUBLE)), 6) AS mean_kept
  FROM (SELECT p.n + a.n + b.n + 2 AS n FROM lens p JOIN lens a ON a.a_for = p.p_id JOIN lens b ON b.b_for = p.p_id),
  (SELECT UNNEST([1024, 1536, 1800, 2048, 3072]) AS cap) GROUP BY cap"""
)
ORACLE["clean_text"] = """SELECT doc_id AS id, CASE WHEN doc_id % 23 = 0 THEN '' ELSE text END AS text,
  CASE WHEN doc_id % 29 = 0 THEN '' ELSE lang END AS lang, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE n_chars END AS n_chars FROM documents"""
_dirty_rest = "is_code_task, winner_model_a, winner_model_b, winner_tie FROM dirty"
ORACLE["clean_features"] = sql(
    f"""SELECT id, cluster_id_k20, len_p, len_diff,
  ROUND(CASE WHEN len_ratio IS NULL OR ISNAN(len_ratio) OR ISINF(len_ratio) THEN 0.0 ELSE len_ratio END, 6) AS len_ratio, {_dirty_rest}"""
)
ORACLE["clean_features_null"] = sql(
    f"""SELECT id, cluster_id_k20, len_p, len_diff,
  ROUND(CASE WHEN ISNAN(len_ratio) OR ISINF(len_ratio) THEN NULL ELSE len_ratio END, 6) AS len_ratio, {_dirty_rest}"""
)
_numbers = ("id", "cluster_id_k20", "cluster_id", "len_p", "len_diff", "len_ratio", "is_code_task", "winner_model_a", "winner_model_b", "winner_tie")
ORACLE["cleaning_report"] = sql(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, COUNT(*) FILTER (WHERE v IS NULL) AS n_null, COUNT(*) FILTER (WHERE ISNAN(v)) AS n_nan,
  COUNT(*) FILTER (WHERE ISINF(v)) AS n_inf FROM (SELECT CAST({c if c != "cluster_id" else "cluster_id_k20"} AS DOUBLE) AS v FROM dirty)"""
        for c in _numbers
    )
)
_lengths = ("len_p", "len_a", "len_b", "len_diff", "len_ratio", "expansion_a", "expansion_b", "expansion_diff")
_flags = tuple(f"{flag}_{s}" for flag in RESPONSE_FLAGS for s in ("a", "b"))
_interactions = ("len_diff_x_is_code_task", "len_ratio_x_read_diff")
_doubles = (*_lengths, "read_diff", *_interactions)
ORACLE["pair_features"] = sql(
    "SELECT f.id, cluster_id_k20, winner_model_a, winner_model_b, winner_tie, "
    + ", ".join(f"ROUND({c}, 6) AS {c}" for c in _doubles)
    + ", "
    + ", ".join((*_flags, "is_code_task"))
    + ", ROUND(cosine_sim, 6) AS cosine_sim FROM features f JOIN cosine c ON c.id = f.id"
)
_GROUPS = {
    "Length & Ratio": _lengths,
    "Formatting": ("has_list_a", "has_list_b", "has_code_a", "has_code_b"),
    "Style & Semantic": ("read_diff", *[f"{f}_{s}" for f in ("has_emoji", "is_polite", "has_disclaimer", "is_refusal") for s in ("a", "b")]),
    "Topic & Task": ("cluster_id_k20", "is_code_task", "len_diff_x_is_code_task"),
    "Interaction": _interactions,
}
ORACLE["feature_profile"] = sql(
    """SELECT feature_group, feature, COUNT(v) AS count, ROUND(AVG(v), 6) AS mean, ROUND(STDDEV_SAMP(v), 6) AS std,
  ROUND(MIN(v), 6) AS min, ROUND(QUANTILE_CONT(v, 0.25), 6) AS q25, ROUND(QUANTILE_CONT(v, 0.5), 6) AS q50,
  ROUND(QUANTILE_CONT(v, 0.75), 6) AS q75, ROUND(MAX(v), 6) AS max FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{g}' AS feature_group, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM features" for g, members in _GROUPS.items() for c in members
    )
    + ") GROUP BY feature_group, feature"
)


def _log_softmax(cols: list[str]) -> list[str]:
    total = " + ".join(f"EXP({c})" for c in cols)
    return [f"(({c}) - LN({total}))" for c in cols]


def _distill(mode: str) -> str:
    student = _log_softmax([f"2 * m2_{s}" for s in _SIDES])  # logits 4 * m2, temperature 2
    hard = _log_softmax([f"4 * m2_{s}" for s in _SIDES])
    if mode == "as_is":
        target = _softmax([f"m1_{s} / 2" for s in _SIDES])
    else:
        target = [f"SQRT(m1_{s}) / (SQRT(m1_a) + SQRT(m1_b) + SQRT(m1_tie))" for s in _SIDES]
    soft = " + ".join(f"({t}) * (LN({t}) - {q})" for t, q in zip(target, student))
    return f"""SELECT '{mode}' AS mode, -(CASE y WHEN 0 THEN {hard[0]} WHEN 1 THEN {hard[1]} ELSE {hard[2]} END) AS h, 4 * ({soft}) AS s FROM pred"""


ORACLE["distill_loss"] = sql(
    f"""SELECT mode, COUNT(*) AS n, ROUND(AVG(h), 6) AS hard_loss, ROUND(AVG(s), 6) AS soft_loss, ROUND(AVG(0.5 * h + 0.5 * s), 6) AS loss
  FROM ({_distill("as_is")} UNION ALL {_distill("renormalised")}) GROUP BY mode"""
)

# ---------------------------------------------------------------- looking at rows

ORACLE["sample_pairs"] = sql(
    """SELECT id, p_text AS prompt, a_text AS response_a, b_text AS response_b,
  CASE y WHEN 0 THEN 'Model A' WHEN 1 THEN 'Model B' ELSE 'Tie' END AS winner
  FROM pairs ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 10"""
)
ORACLE["conflict_cases"] = sql(
    """SELECT id, len_diff, ROUND(pred_a, 6) AS pred_a, ROUND(pred_b, 6) AS pred_b, winner,
  SUBSTRING(p_text, 1, 200) || '...' AS prompt_head FROM conflicts"""
)
ORACLE["conflict_sample"] = sql(
    """SELECT id, len_diff, ROUND(pred_a, 6) AS pred_a, ROUND(pred_b, 6) AS pred_b, winner FROM conflicts
  ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 3"""
)

# ---------------------------------------------------------------- files

ORACLE["csv_roundtrip"] = sql(
    """SELECT id, md5(p_text) AS prompt_text_md5, md5(a_text) AS res_a_text_md5, md5(b_text) AS res_b_text_md5, cluster_id_k20,
  winner_model_a, winner_model_b, winner_tie FROM pairs"""
)
ORACLE["jsonl_roundtrip"] = sql(
    """SELECT md5(p_text) AS prompt_md5, md5(CASE WHEN y = 0 THEN a_text ELSE b_text END) AS chosen_md5,
  md5(CASE WHEN y = 0 THEN b_text ELSE a_text END) AS rejected_md5 FROM pairs WHERE y <> 2"""
)

ORACLE["csv_crlf"] = sql("SELECT id, cluster_id_k20, winner_model_a, winner_model_b, winner_tie FROM pred")
ORACLE["csv_split"] = ORACLE["csv_roundtrip"]
ORACLE["snapshot_read"] = sql(
    """SELECT CAST(1 AS INTEGER) AS version, COUNT(*) AS n_rows, CAST(SUM(CAST(ROUND(m1_a * 1e6) AS BIGINT)) AS BIGINT) AS sum_a
  FROM pred WHERE id % 50 <> 0 UNION ALL
  SELECT 2, COUNT(*), CAST(SUM(CAST(ROUND(a * 1e6) AS BIGINT)) AS BIGINT)
  FROM (SELECT m1_a / 2 AS a FROM pred UNION ALL SELECT m1_a FROM pred WHERE id % 50 <> 0)"""
)
ORACLE["glob_union"] = sql(
    " UNION ALL ".join(f"SELECT id, ROUND({m}_a, 6) AS pred_a, ROUND({m}_b, 6) AS pred_b, ROUND({m}_tie, 6) AS pred_tie FROM pred" for m in _MODELS)
)
ORACLE["optional_sources"] = "SELECT 'm1' AS source, COUNT(*) AS n_rows FROM documents UNION ALL SELECT 'm2', COUNT(*) FROM documents"

# ---------------------------------------------------------------- ensembles

_true_probs = ", ".join(f"CASE y WHEN 0 THEN {m}_a WHEN 1 THEN {m}_b ELSE {m}_tie END AS q{m[1]}" for m in _MODELS)
_CTES["picked"] = f"SELECT id, {_true_probs} FROM pred"
_CTES["grid"] = """SELECT i, j, CAST(i AS DOUBLE) / 20 AS w1, CAST(j AS DOUBLE) / 20 AS w2, CAST(20 - i - j AS DOUBLE) / 20 AS w3
  FROM (SELECT UNNEST(RANGE(21)) AS i), (SELECT UNNEST(RANGE(21)) AS j) WHERE i + j <= 20"""
ORACLE["ensemble_grid"] = sql(
    """SELECT w1 AS w_m1, w2 AS w_m2, w3 AS w_m3,
  ROUND(AVG(-LN(LEAST(GREATEST(w1 * q1 + w2 * q2 + w3 * q3, 1e-15), 1 - 1e-15))), 6) AS log_loss FROM picked, grid GROUP BY w1, w2, w3"""
)
# Newton's method in the two free weights; the optimum of these inputs lies inside the simplex.
_NEWTON = """newton(it, w1, w2, loss) AS (
  SELECT 0, CAST(1.0 AS DOUBLE) / 3, CAST(1.0 AS DOUBLE) / 3, CAST(NULL AS DOUBLE)
  UNION ALL
  SELECT it + 1, w1 - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), w2 - (haa * gb - hab * ga) / (haa * hbb - hab * hab), f FROM (
    SELECT it, w1, w2, AVG(-LN(s)) AS f, AVG(-a / s) AS ga, AVG(-b / s) AS gb,
    AVG(a * a / (s * s)) AS haa, AVG(b * b / (s * s)) AS hbb, AVG(a * b / (s * s)) AS hab
    FROM (SELECT it, w1, w2, q1 - q3 AS a, q2 - q3 AS b, w1 * q1 + w2 * q2 + (1 - w1 - w2) * q3 AS s FROM newton, picked WHERE it < 12)
    GROUP BY it, w1, w2))"""
ORACLE["ensemble_weights"] = sql(
    """SELECT model, ROUND(weight, 6) AS weight, ROUND(loss, 6) AS log_loss FROM (
  SELECT 'm1' AS model, w1 AS weight, loss FROM newton WHERE it = 12 UNION ALL SELECT 'm2', w2, loss FROM newton WHERE it = 12
  UNION ALL SELECT 'm3', 1 - w1 - w2, loss FROM newton WHERE it = 12)""",
    recursive=_NEWTON,
)


def _mix(side: str) -> str:
    return " + ".join(f"{w} * {m}_{side}" for m, w in BLEND_WEIGHTS.items())


_CTES["mixed"] = f"SELECT y, {', '.join(f'{_mix(s)} AS x{s}' for s in _SIDES)} FROM pred"
ORACLE["blend_metrics"] = sql(
    """SELECT model, COUNT(*) AS n, ROUND(AVG(loss), 6) AS log_loss, ROUND(AVG(CASE WHEN c = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy
  FROM (SELECT model, loss, c, y FROM scored UNION ALL
    SELECT 'blend', -LN(CASE y WHEN 0 THEN xa WHEN 1 THEN xb ELSE xtie END),
    CASE WHEN xa >= xb AND xa >= xtie THEN 0 WHEN xb >= xtie THEN 1 ELSE 2 END, y FROM mixed) GROUP BY model"""
)
ORACLE["fold_softmax_weights"] = sql(
    """SELECT model, fold, ROUND(log_loss, 6) AS score, ROUND(e / SUM(e) OVER (PARTITION BY model), 6) AS weight FROM (
  SELECT *, EXP((MIN(log_loss) OVER (PARTITION BY model) - log_loss) / 0.05) AS e FROM by_fold)"""
)

# ---------------------------------------------------------------- logs

_CURVES = """SELECT kind, model_type, epoch, COUNT(*) AS n, ROUND(AVG(loss), 6) AS mean_loss, ROUND(STDDEV_SAMP(loss), 6) AS sd_loss
  FROM records GROUP BY kind, model_type, epoch"""
ORACLE["log_curves"] = sql(_CURVES)
ORACLE["stream_log_curves"] = sql(_CURVES)
ORACLE["log_curves_run"] = sql(
    "SELECT kind, run, epoch, COUNT(*) AS n, ROUND(AVG(loss), 6) AS mean_loss FROM records GROUP BY kind, run, epoch"
)
_CTES["saved"] = "SELECT run, loss, 100 * (k + 1) AS step FROM records WHERE kind = 'eval'"
ORACLE["best_checkpoint"] = sql(
    """SELECT run, 'checkpoint-' || CAST(step AS VARCHAR) AS checkpoint, step FROM (
  SELECT run, step, ROW_NUMBER() OVER (PARTITION BY run ORDER BY loss, step) AS r FROM saved) WHERE r = 1"""
)
ORACLE["resolve_checkpoint"] = sql(
    """SELECT run, 'outputs/' || run || '/checkpoint-' || CAST(CASE WHEN run LIKE 'M1%' THEN first ELSE last END AS VARCHAR) AS checkpoint,
  CASE WHEN run LIKE 'M1%' THEN 'best' ELSE 'latest' END AS chosen_by FROM (
  SELECT run, MAX(step) AS last, MAX(CASE WHEN r = 1 THEN step END) AS first FROM (
    SELECT run, step, ROW_NUMBER() OVER (PARTITION BY run ORDER BY loss, step) AS r FROM saved) GROUP BY run)"""
)
ORACLE["latest_checkpoint"] = sql(
    "SELECT run, 'outputs/' || run || '/checkpoint-' || CAST(MAX(step) AS VARCHAR) AS latest_checkpoint, MAX(step) AS step FROM saved GROUP BY run"
)
ORACLE["stream_fold_metrics"] = ORACLE["fold_metrics"]

ORACLE["stream_fold_metrics_late"] = "SELECT *, (SELECT COUNT(*) FROM documents WHERE doc_id % 100 = 0) AS n_late FROM (" + ORACLE["fold_metrics"] + ")"
ORACLE["align_hot_keys"] = sql(
    "SELECT h.cluster_id_k20, COUNT(*) AS n, "
    + ", ".join(f"CAST(SUM(CAST(ROUND(p.{m}_{s} * 1e6) AS BIGINT)) AS BIGINT) AS sum_{m}_{s}" for m in ("m1", "m2") for s in _SIDES)
    + " FROM (SELECT CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS id, cluster_id_k20 FROM pred) h JOIN pred p ON p.id = h.id GROUP BY h.cluster_id_k20"
)

# ---------------------------------------------------------------- learning


def _logit(cls: int, features: tuple[str, ...] = SCORER_INPUTS) -> str:
    def by_fold(i: int) -> str:
        whens = " ".join(f"WHEN {k} THEN {scorer_coefficient(k, cls, i)}" for k in range(N_FOLDS))
        return f"CAST(CASE fold {whens} END AS DOUBLE)"

    return " + ".join([by_fold(0), *[f"{by_fold(i + 1)} * {c}" for i, c in enumerate(features)]])


_linear = _softmax([f"l{c}" for c in range(3)])
ORACLE["oof_score"] = sql(
    "SELECT id, fold, "
    + ", ".join(f"ROUND({e}, 6) AS pred_{s}" for e, s in zip(_linear, _SIDES))
    + f" FROM (SELECT id, fold, {', '.join(f'{_logit(c)} AS l{c}' for c in range(3))} FROM folds)"
)
_PROMPT = _fill(JUDGE_TEMPLATE, {s: f"{s}_text" for s in ("p", "a", "b")})
_shape = ("n / (n + 2000.0)", "n_e / n", "n_space / n")
ORACLE["oof_score_text"] = sql(
    "SELECT id, fold, "
    + ", ".join(f"ROUND({e}, 6) AS pred_{s}" for e, s in zip(_linear, _SIDES))
    + f" FROM (SELECT id, fold, {', '.join(f'{_logit(c, _shape)} AS l{c}' for c in range(3))} FROM ("
    + "SELECT id, fold, CAST(LENGTH(t) AS DOUBLE) AS n, LENGTH(t) - LENGTH(REPLACE(t, 'e', '')) AS n_e, LENGTH(t) - LENGTH(REPLACE(t, ' ', '')) AS n_space"
    + f" FROM (SELECT p.id, f.fold, {_PROMPT} AS t FROM pairs p JOIN folds f ON f.id = p.id)))"
)
# Contracts of learned results: values cannot be had from SQL, what must hold can.
ORACLE["stack_oof_contract"] = """SELECT UNNEST(['leafwise', 'depthwise']) AS variant, n AS n_rows, n AS n_ids, CAST(0 AS BIGINT) AS n_missing,
  n AS n_sum_one, TRUE AS better_than_guess, TRUE AS better_than_inputs FROM (SELECT COUNT(*) AS n FROM documents)"""
ORACLE["stack_blend"] = "SELECT CAST(3 AS BIGINT) AS n_models, TRUE AS on_simplex, TRUE AS no_worse"
ORACLE["search_contract"] = """SELECT space, CAST(rung AS INTEGER) AS rung, CAST(n AS BIGINT) AS n_trials, CAST(rounds AS BIGINT) AS rounds, CAST(up AS BIGINT) AS n_promoted,
  CAST(0 AS BIGINT) AS n_not_promoted_before, CAST(0 AS BIGINT) AS n_worse_than_before, TRUE AS best_go_on
  FROM (VALUES (0, 50, 1, 17), (1, 17, 3, 6), (2, 6, 9, 2), (3, 2, 27, 0)) v(rung, n, rounds, up), (SELECT UNNEST(['leafwise', 'depthwise']) AS space)"""
ORACLE["importance_contract"] = """SELECT * FROM (VALUES ('leafwise', CAST(5 AS BIGINT), CAST(37 AS BIGINT), CAST(0 AS BIGINT), TRUE),
  ('depthwise', CAST(5 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), TRUE)) v(model, n_folds, n_features, n_negative, sums_up)"""
ORACLE["fold_encoding"] = sql(
    f"""SELECT id, ROUND((na + 10 * wa / (wa + wb + wt)) / (na + nb + nt + 10), 6) AS cluster_id_k20__a, ROUND((nb + 10 * wb / (wa + wb + wt)) / (na + nb + nt + 10), 6) AS cluster_id_k20__b,
  ROUND((nt + 10 * wt / (wa + wb + wt)) / (na + nb + nt + 10), 6) AS cluster_id_k20__tie
  FROM (SELECT id, {", ".join(f"COUNT(*) FILTER (y = {c}) OVER (PARTITION BY cluster_id_k20) - COUNT(*) FILTER (y = {c}) OVER (PARTITION BY cluster_id_k20, fold) AS n{s}, CAST(COUNT(*) FILTER (y = {c}) OVER () - COUNT(*) FILTER (y = {c}) OVER (PARTITION BY fold) AS DOUBLE) AS w{s}" for c, s in enumerate("abt"))}
    FROM (SELECT id, cluster_id_k20, y, {_FOLD.format(g='target')} FROM (SELECT id, cluster_id_k20, y, CAST(y AS VARCHAR) AS target FROM pred)))"""
)

# ---------------------------------------------------------------- small steps

ORACLE["scoring_columns"] = sql(
    "SELECT id, " + " || ' ' || ".join(f"CAST(CAST(ROUND({c} * 1e6) AS BIGINT) AS VARCHAR)" for c in ("m2_a", "m1_tie", "m1_a")) + " AS vector FROM pred"
)
ORACLE["fold_union"] = sql("SELECT id, fold FROM folds")
ORACLE["feature_toggles"] = sql(
    " UNION ALL ".join(
        f"SELECT '{choice}' AS choice, '{c}' AS feature, COUNT({c}) AS n FROM pred"
        for choice, names in {
            "manual": ("cluster_id_k20",),
            "m1": ("m1_a", "m1_b", "m1_tie"),
            "all": ("cluster_id_k20", "m1_a", "m1_b", "m1_tie", "m3_a", "m3_b", "m3_tie"),
        }.items()
        for c in names
    )
)
ORACLE["guarded_samples"] = sql(
    """SELECT name AS sampled_from, id FROM (
    SELECT name, id, COUNT(*) OVER (PARTITION BY name) AS n, ROW_NUMBER() OVER (PARTITION BY name ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) AS r
    FROM (SELECT 'tie' AS name, id FROM pred WHERE winner_tie = 1 UNION ALL SELECT 'key 77', id FROM pred WHERE id % 77 = 0
      UNION ALL SELECT 'key 7777', id FROM pred WHERE id % 7777 = 0)) WHERE n >= 50 AND r <= 50"""
)
ORACLE["ordered_heads"] = sql(
    """SELECT 'source' AS sorted_by, id, fold FROM (SELECT * FROM folds ORDER BY id LIMIT 100) UNION ALL
  SELECT 'fold', id, fold FROM (SELECT * FROM folds ORDER BY fold, id LIMIT 100) UNION ALL
  SELECT 'head', id, fold FROM (SELECT * FROM folds ORDER BY id LIMIT 3)"""
)
