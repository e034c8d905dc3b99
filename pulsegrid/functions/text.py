"""Column builders for cleaning text and numbers. No UDFs: everything stays in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Answer words and ordinal keywords, in the order in which they are tried.
YES_WORDS = ("yes", "y", "evet", "true", "1")
YES_PARTS = ("yes", "evet")
NO_WORDS = ("no", "n", "hayır", "hayir", "false", "0")
NO_PARTS = ("no", "hayır", "hayir")
ORDINAL_KEYWORDS = (
    ("not severe", 0.0), ("hiç", 0.0), ("low", 1.0), ("mild", 1.0), ("hafif", 1.0), ("moderate", 3.0), ("orta", 3.0),
    ("high", 4.0), ("severe", 5.0), ("şiddetli", 5.0), ("stressed", 4.0), ("stressli", 4.0),
)
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
FIRST_NUMBER = r"\d+(?:\.\d+)?"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def canonical_name(c: Column | str) -> Column:
    """Lower snake case: byte-order mark dropped, runs of other characters become one underscore."""
    bare = F.regexp_replace(strip(c), "﻿", "")
    return F.lower(F.btrim(F.regexp_replace(bare, "[^0-9A-Za-z]+", "_"), F.lit("_")))


def canonical_columns(df: DataFrame) -> DataFrame:
    """Apply the same rule to the column names of a table (schema only, no job)."""
    import re

    names = [re.sub("[^0-9A-Za-z]+", "_", n.strip().replace("﻿", "")).strip("_").lower() for n in df.columns]
    return df.toDF(*names)


def clean_text(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def clean_numeric(c: Column | str) -> Column:
    """Decimal comma accepted; anything that is not a plain number becomes NULL."""
    text = F.replace(strip(_col(c).cast("string")), F.lit(","), F.lit("."))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def numeric_first(c: Column | str) -> Column:
    text = F.replace(_col(c), F.lit(","), F.lit("."))
    return F.nullif(F.regexp_extract(text, FIRST_NUMBER, 0), F.lit("")).try_cast("double")


def _has_any(text: Column, words: Sequence[str], parts: Sequence[str]) -> Column:
    hit = text.isin(*words)
    for part in parts:
        hit = hit | text.contains(part)
    return hit


def yes_no_flag(c: Column | str) -> Column:
    text = F.lower(strip(c))
    return F.when(_has_any(text, YES_WORDS, YES_PARTS), 1.0).when(_has_any(text, NO_WORDS, NO_PARTS), 0.0)


def ordinal_text_score(c: Column | str) -> Column:
    text = F.lower(strip(c))
    chain = None
    for word, score in ORDINAL_KEYWORDS:
        cond = text.contains(word)
        chain = F.when(cond, F.lit(score)) if chain is None else chain.when(cond, F.lit(score))
    return F.coalesce(numeric_first(c), chain)


def row_mean(columns: Sequence[Column | str]) -> Column:
    """Mean of the non-null values of one row."""
    total, count = F.lit(0.0), F.lit(0)
    for c in columns:
        total = total + F.coalesce(_col(c).cast("double"), F.lit(0.0))
        count = count + F.when(_col(c).isNotNull(), 1).otherwise(0)
    return F.when(count > 0, total / count)


def split_part_number(c: Column | str, index: int, sep: str = "/") -> Column:
    """Numeric part ``index`` (0-based) of a separated pair such as 120/80."""
    return clean_numeric(F.get(F.split(_col(c), sep), index))


def zero_padded_id(c: Column | str, width: int = 3) -> Column:
    bare = F.regexp_replace(_col(c), r"\.0$", "")
    return F.when(F.length(bare) >= width, bare).otherwise(F.lpad(bare, width, "0"))


def session_key(subject: Column | str, kind: Column | str, scale: Column | str) -> Column:
    return F.concat(_col(subject), F.lit("_"), _col(kind), F.lit("_scale_"), F.coalesce(_col(scale).cast("string"), F.lit("unknown")))


def magnitude(x: Column | str, y: Column | str, z: Column | str) -> Column:
    a, b, c = _col(x), _col(y), _col(z)
    return F.sqrt(a * a + b * b + c * c)


def minute_floor(ts: Column | str) -> Column:
    return F.date_trunc("minute", _col(ts))


def minute_ceil(ts: Column | str) -> Column:
    base = minute_floor(ts)
    return F.when(base < _col(ts), base + F.expr("INTERVAL 1 MINUTE")).otherwise(base)


# Path keys -----------------------------------------------------------------------------------

# The archives' member paths.
CLINICAL_SESSION = r"/?(P(\d+)_(\d+))/\1\.csv$"
PATH_PATTERNS = {
    "heat": (r"S_(\d+)-synchronised-data\.csv$", ("subject",)),
    "task": (r"CATSA/(Sub\d+)/([^/]+)/(ACC|BVP|EDA|HR|TEMP)\.csv$", ("subject", "condition", "sensor")),
    "activity": (r"/Wearable_Dataset/([^/]+)/(S\d+)/(ACC|BVP|EDA|HR|IBI|TEMP)\.csv$", ("condition", "subject", "sensor")),
    "eeg": (r"/PROCESSED EEG DATA/1Hz/([^/]+)_1hz/(S\d+)\.csv$", ("pain_type", "subject")),
}


def clinical_session_keys(path: Column | str) -> dict[str, Column]:
    """Subject, session and trial number of a clinical member path; a path that does not match raises."""
    p = _col(path)
    session = F.regexp_extract(p, CLINICAL_SESSION, 1)
    checked = F.when(session != "", F.lower(session)).otherwise(
        F.raise_error(F.concat(F.lit("not a clinical session path: "), p)).cast("string")
    )
    return {
        "subject_id": F.concat(F.lit("p"), F.regexp_extract(p, CLINICAL_SESSION, 2)),
        "session_id": checked,
        "session_number": F.regexp_extract(p, CLINICAL_SESSION, 3).try_cast("int"),
    }


def path_keys(path: Column | str, kind: str) -> dict[str, Column]:
    pattern, names = PATH_PATTERNS[kind]
    return {n: F.nullif(F.regexp_extract(_col(path), pattern, i), F.lit("")) for i, n in enumerate(names, 1)}
