"""Column functions: text cells, labels, order keys, identifiers, losses and formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Cells that count as missing, after trimming and lower-casing.
MISSING = ("", "na", "n/a", "nan", "null", "none")
# Label words of the contract, and those of the stand-alone profiler.
NEGATIVE, POSITIVE = ("0", "normal", "benign"), ("1", "attack", "malicious", "anomaly")
PROFILE_NEGATIVE, PROFILE_POSITIVE = ("0", "normal", "benign", "false"), ("1", "attack", "malicious", "anomaly", "true")
# What marks a state key as belonging to batch normalisation.
BATCH_NORM = ("bn", "batchnorm", "running_mean", "running_var", "num_batches_tracked")
#: The category of a missing cell.
UNKNOWN = "UNKNOWN"
#: Text in place of a ranking metric that needs both classes.
UNAVAILABLE = "metric_unavailable_single_class"

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
#: Numbers as Python's float() reads them, of a trimmed cell.
NUMBER = rf"(?i)^[+-]?(?:inf|infinity|nan|(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?)$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def header_name(name: str) -> str:
    """A header cell without byte-order marks; spaces stay."""
    return name.lstrip(chr(0xFEFF))


def trimmed(c: str | Column) -> Column:
    """White space of any kind off both ends; null becomes the empty string, as in a CSV cell."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)^\s+|\s+$", "")


def is_missing(c: str | Column) -> Column:
    return F.lower(trimmed(c)).isin(*MISSING)


def to_number(c: str | Column) -> Column:
    """The cell as a double by Python's rules, null if it is none; ``1d`` and ``0x10`` are none, ``1_000`` is one."""
    cell = trimmed(c)
    return F.when(cell.rlike(NUMBER), F.replace(cell, F.lit("_"), F.lit("")).try_cast("double"))


def is_number(c: str | Column) -> Column:
    return trimmed(c).rlike(NUMBER)


def feature_number(c: str | Column) -> Column:
    """A numeric cell rounded to single precision as a double; missing and NaN cells are null."""
    value = F.when(~is_missing(c), to_number(c)).cast("float").cast("double")
    return F.when(~F.isnan(value), value)


def binary_label(c: str | Column) -> Column:
    """Contract labels: 0, 1 or null where the value must be rejected."""
    cell = F.lower(trimmed(c))
    return F.when(cell.isin(*NEGATIVE), 0).when(cell.isin(*POSITIVE), 1).when(to_number(c) == 0.0, 0).when(to_number(c) == 1.0, 1).cast("tinyint")


def profile_label(c: str | Column) -> Column:
    """The stand-alone profiler's labels: true and false count, other spellings of numbers do not."""
    cell = F.lower(trimmed(c))
    return F.when(cell.isin(*PROFILE_NEGATIVE), 0).when(cell.isin(*PROFILE_POSITIVE), 1).cast("tinyint")


def category(c: str | Column) -> Column:
    """The trimmed cell, UNKNOWN if it is missing."""
    return F.when(is_missing(c), F.lit(UNKNOWN)).otherwise(trimmed(c))


def day_key(c: str | Column) -> Column:
    """``25-Apr-19`` as ``2019-04-25``, so that text order is date order; null for other cells."""
    return F.try_to_timestamp(trimmed(c), F.lit("d-MMM-yy")).cast("date").cast("string")


def timestamp_of(c: str | Column) -> Column:
    """An ISO-8601 text with an offset or Z as a timestamp, null if it is none."""
    return F.try_to_timestamp(_col(c))


def client_name(cluster: str | Column, client: str | Column) -> Column:
    """``C1_L001`` from a cluster and a client number counted from 1."""
    return F.format_string("C%d_L%03d", _col(cluster), _col(client))


def round_name(cluster: str | Column, number: str | Column) -> Column:
    return F.format_string("C%d_R%03d", _col(cluster), _col(number))


def head_name(cluster: str | Column) -> Column:
    return F.format_string("MC%d_HEAD", _col(cluster))


def trial_name(number: str | Column) -> Column:
    return F.format_string("trial_%04d", _col(number))


def client_number(c: str | Column) -> Column:
    """The number after the last L of a client name."""
    return F.substring_index(_col(c), "L", -1).cast("int")


def source_name(path: str | Column, prefix: str = "Train_Test_IoT_") -> Column:
    """The lower-cased rest of a file name after a prefix, without .csv."""
    return F.lower(F.regexp_extract(_col(path), rf"{prefix}([^/]*)\.csv$", 1))


def is_batch_norm(key: str | Column) -> Column:
    return F.lower(_col(key)).rlike("|".join(BATCH_NORM))


def sigmoid(logit: str | Column, clip: float = 30.0, margin: float = 1e-6) -> Column:
    """Probability of a logit, clipped on both sides of the function."""
    x = F.greatest(F.least(_col(logit), F.lit(clip)), F.lit(-clip))
    return F.greatest(F.least(1.0 / (1.0 + F.exp(-x)), F.lit(1.0 - margin)), F.lit(margin))


def softplus(x: str | Column) -> Column:
    x = _col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logit_loss(logit: str | Column, label: str | Column, positive_weight: float = 1.0) -> Column:
    """Binary cross-entropy of one logit; positives weigh ``positive_weight``."""
    y = _col(label).cast("double")
    return F.lit(positive_weight) * y * softplus(-_col(logit)) + (1.0 - y) * softplus(logit)


def logit_gradient(logit: str | Column, label: str | Column, positive_weight: float = 1.0) -> Column:
    """Derivative of ``logit_loss`` by the logit, of one row."""
    y, p = _col(label).cast("double"), 1.0 / (1.0 + F.exp(-_col(logit)))
    return (1.0 - y) * p - F.lit(positive_weight) * y * (1.0 - p)


def log_loss(p: str | Column, label: str | Column, margin: float = 1e-6) -> Column:
    """Log loss of one probability, clipped to [margin, 1 - margin]."""
    clipped = F.greatest(F.least(_col(p), F.lit(1.0 - margin)), F.lit(margin))
    return F.when(_col(label) == 1, -F.log(clipped)).otherwise(-F.log1p(-clipped))


def mebibytes(c: str | Column) -> Column:
    return _col(c) / F.lit(1048576.0)


def mean_std_text(mean: str | Column, std: str | Column) -> Column:
    """``0.9000 +- 0.0816``, NOT AVAILABLE without a mean."""
    text = F.format_string("%.4f +- %.4f", _col(mean), F.coalesce(_col(std), F.lit(0.0)))
    return F.when(_col(mean).isNull(), F.lit("NOT AVAILABLE")).otherwise(text)


def retyped(c: str | Column) -> Column:
    """A metrics cell as a double; blanks, the single-class text and other words are null."""
    return F.when(~is_missing(c), trimmed(c).try_cast("double"))


def sha256_or(c: str | Column, fallback: str | Column) -> Column:
    """A prefixed or bare SHA-256 in prefixed form; anything else gives the digest of ``fallback``."""
    cell = F.coalesce(_col(c), F.lit(""))
    return F.when(cell.rlike("^sha256:[0-9a-f]{64}$"), cell).when(cell.rlike("^[0-9a-f]{64}$"), F.concat(F.lit("sha256:"), cell)).otherwise(F.concat(F.lit("sha256:"), F.sha2(_col(fallback), 256)))


def confusion_counts(c: str | Column) -> Column:
    """A confusion matrix in JSON as (tn, fp, fn, tp), null unless it is two by two."""
    matrix = F.from_json(_col(c), "array<array<bigint>>")
    square = (F.size(matrix) == 2) & F.forall(matrix, lambda row: F.size(row) == 2)
    cells = {n: F.get(F.get(matrix, F.lit(i)), F.lit(j)) for n, (i, j) in {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}.items()}
    return F.when(square, F.struct(*(v.alias(n) for n, v in cells.items())))


def one_hot(c: str | Column, categories: list[str]) -> Column:
    """An array of 0 and 1 by category; a value outside them gives zeros."""
    return F.transform(F.array(*[F.lit(v) for v in categories]), lambda v: (v == _col(c)).cast("float"))
