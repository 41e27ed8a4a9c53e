"""Training-log lines and checkpoint paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.labels import ColumnOrName, as_col
from pairwright.schema import LOG_RECORD_SCHEMA

#: From the first brace to the last, with nothing but blanks after it. No repeated groups: Java would
#: need stack space for every character of a long line.
_RECORD = r"^[^{]*(\{.*\})\s*$"
_TWO_RECORDS = r"\{.*\}\s*\{"


def log_record(line: ColumnOrName) -> Column:
    """The dict literal of a log line as a struct of numbers; all NULL when there is none to read.

    The JSON reader takes single quotes, and gives NULLs for a line it cannot read, such as one that
    holds a bare ``nan``. It would read the first of two records on one line, so such a line is left out here.
    """
    line = as_col(line)
    single = F.when(~F.regexp_like(line, F.lit(_TWO_RECORDS)), F.regexp_extract(line, _RECORD, 1))
    return F.from_json(single, LOG_RECORD_SCHEMA)


def record_kind(loss: ColumnOrName = "loss", eval_loss: ColumnOrName = "eval_loss", epoch: ColumnOrName = "epoch") -> Column:
    """``eval`` when the record has an evaluation loss, else ``train``; NULL when it is neither."""
    has_epoch = as_col(epoch).isNotNull()
    is_eval, is_train = as_col(eval_loss).isNotNull(), as_col(loss).isNotNull()
    return F.when(has_epoch & is_eval, "eval").when(has_epoch & is_train, "train")


def record_loss(loss: ColumnOrName = "loss", eval_loss: ColumnOrName = "eval_loss") -> Column:
    return F.coalesce(as_col(eval_loss), as_col(loss))


def model_type(run: ColumnOrName) -> Column:
    """The part of a run name before its first underscore."""
    return F.split(as_col(run), "_")[0]


def basename(path: ColumnOrName) -> Column:
    return F.regexp_extract(as_col(path), r"([^/]+)$", 1)


def checkpoint_step(path: ColumnOrName) -> Column:
    """The number in ``checkpoint-<number>``; 0 for any other name."""
    digits = F.regexp_extract(as_col(path), r"checkpoint-(\d+)", 1)
    return F.when(digits != "", digits.cast("long")).otherwise(F.lit(0).cast("long"))
