"""Text normalization and distances: column expressions where Spark has them, else Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of the Latin and Cyrillic scripts that look alike.
LATIN = "aABcCeEHiKMoOpPTxXy"
CYRILLIC = "аАВсСеЕНіКМоОрРТхХу"
#: Dashes and quotes that count as one for metrics.
DASHES = "‐‑‒–—―"
QUOTES = "«»„“”‟‘’"
_to_cyrillic, _to_latin = str.maketrans(LATIN, CYRILLIC), str.maketrans(CYRILLIC, LATIN)
_token = re.compile(r"[^\W_]+")


def one_script(token: str) -> str:
    """A token of both scripts in the one most of its letters have (Cyrillic on a tie)."""
    latin = sum(c.isascii() and c.isalpha() for c in token)
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in token)
    if not latin or not cyrillic or any(c.isdigit() for c in token):
        return token
    return token.translate(_to_latin if latin > cyrillic else _to_cyrillic)


def normalized(value: str) -> str:
    """NFC, then look-alikes of mixed tokens."""
    return _token.sub(lambda m: one_script(m[0]), unicodedata.normalize("NFC", value))


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no function for it."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def normalize_text(values: pd.Series) -> pd.Series:
    """NFC and one script for each mixed token."""
    return values.map(lambda v: None if v is None else normalized(v))


def with_normalized(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a text column normalized, as a step of its own: a UDF call over
    an expression with lambdas isn't taken out of its projection."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if v is None else normalized(v) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(values, pa.string()), *batch.columns[at + 1 :]], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def stripped(value: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(value, r"(?U)\A\s+|\s+\z", "")


def normalize_for_metric(value: Column, mode: str = "normalized", unicode: bool = True) -> Column:
    """``strict``: only line ends are made alike. ``normalized``: also NFC (unless
    ``unicode`` is false), soft hyphens, dashes, quotes, runs of spaces, empty lines, case."""
    if mode not in ("strict", "normalized"):
        raise ValueError(f"unknown mode {mode!r}")
    value = F.regexp_replace(value, "\r\n?", "\n")
    if mode == "strict":
        return value
    value = nfc(value) if unicode else value
    value = F.translate(value, DASHES + QUOTES + "­", "-" * len(DASHES) + '"' * len(QUOTES))
    lines = F.transform(F.split(value, "\n"), lambda x: stripped(F.regexp_replace(x, "[ \t]+", " ")))
    return F.lower(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def _rate(truth: Column, guess: Column, distance: Column, length: Column) -> Column:
    blank, empty = stripped(truth) == "", stripped(guess) == ""
    return F.when(blank, F.when(empty, 0.0).otherwise(1.0)).when(empty, 1.0).otherwise(distance / length).cast("double")


def cer(truth: Column, guess: Column) -> Column:
    """Character error rate of stripped texts; without truth 0 or 1."""
    a, b = stripped(truth), stripped(guess)
    return _rate(truth, guess, character_edits(a, b), F.length(a))


def edit_distance(a: str | list, b: str | list) -> int:
    """Edits between two sequences: a column of the table is a number of as many bits as the
    first has elements, so whole texts cost little more than reading them."""
    if a == b:
        return 0
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, distance = full, 0, len(a)
    for x in b:
        hit = places.get(x, 0)
        across = (((hit & more) + more) ^ more) | hit | less
        up, down = less | ~(across | more) & full, more & across
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        hit |= less
        more, less = down | ~(hit | up) & full, up & hit
    return distance


@F.pandas_udf(T.LongType())
def character_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two texts in characters, whole texts at any length."""
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def word_error(truth: str | None, guess: str | None) -> float:
    a, b = (truth or "").split(), (guess or "").split()
    if not a or not b:
        return float(bool(a) or bool(b))
    return edit_distance(a, b) / len(a)


@F.pandas_udf(T.DoubleType())
def word_error_rate(truth: pd.Series, guess: pd.Series) -> pd.Series:
    """Word error rate (words at white space); without truth 0 or 1."""
    return pd.Series([word_error(a, b) for a, b in zip(truth, guess, strict=True)], dtype="float64")


def digit_groups(value: Column) -> Column:
    return F.array_join(F.regexp_extract_all(value, F.lit("([0-9]+)")), " ")


def digit_cer(truth: Column, guess: Column) -> Column:
    """Character error rate of the groups of digits alone."""
    return cer(digit_groups(truth), digit_groups(guess))


def similarity(a: str, b: str) -> float:
    """Indel ratio: twice the longest common subsequence by both lengths; 1 for two empty texts."""
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts, 0 to 1."""
    return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def digit_tokens(value: Column) -> Column:
    """Tokens (at white space) that hold a digit."""
    return F.filter(F.split(value, r"(?U)\s+"), lambda w: w.rlike("[0-9]"))


def is_page_number(value: Column) -> Column:
    """Whether a line is only a page number, with ``стр.`` or ``бет`` and dashes allowed."""
    return value.rlike(r"(?iuU)\A[\s\-—–]*(?:стр\.?|бет)?[\s\-—–]*[0-9]{1,4}[\s\-—–.]*\z")
