"""Two engines' lines of a page into one: matching by place and similarity, digits never chosen by confidence.

The greedy matching gives each line of the second engine away once, in order of
the first engine's lines, so it is a pure function of a page run by an Arrow UDF.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import similarity
from ..schemas import WORD

LEAST_OVERLAP, ORPHAN_CONFIDENCE = 0.4, 0.6


@dataclass(eq=False)
class Seen:
    """What arbitration needs to know of a line."""

    engine: str
    text: str
    conf: float
    y0: int
    y1: int

    def overlap(self, other: Seen) -> float:
        shared = min(self.y1, other.y1) - max(self.y0, other.y0)
        return 0.0 if shared <= 0 else shared / (min(self.y1 - self.y0, other.y1 - other.y0) or 1)

    def digits(self) -> list[str]:
        return [t for t in self.text.split() if any(map(str.isdigit, t))] if any(map(str.isdigit, set(self.text))) else []


def _mean(confs: list[float]) -> float:
    return sum(confs) / len(confs) if confs else 0.0


def _seen(line) -> Seen:
    words = [] if line["words"] is None else list(line["words"])
    y0, y1 = (min(w["y0"] for w in words), max(w["y1"] for w in words)) if words else (0, 0)
    return Seen(line["engine"], " ".join(w["text"] for w in words if w["text"]), _mean([w["conf"] for w in words]), y0, y1)


def likest(text: str, others: list[tuple[int, str]]) -> int | None:
    """Number of the text of ``others`` (number, text) most similar to ``text``, the first of equal
    ones; None if none has anything in common with it.

    Letters in common are an upper bound of a similarity: only texts that may still be the most
    similar are compared in full, and a single one isn't.
    """
    if len(others) == 1:
        number, other = others[0]
        return None if text != other and set(text).isdisjoint(other) else number
    own, bounds = Counter(text), []
    for place, (_, other) in enumerate(others):
        length = len(text) + len(other)
        bounds.append((-2 * (own & Counter(other)).total() / length if length else -1.0, place))
    best, at = 0.0, None
    for bound, place in sorted(bounds):
        if -bound < best or -bound == best and (at is None or place > at):
            continue
        score = similarity(text, others[place][1])
        if score > best or score == best and at is not None and place < at:
            best, at = score, place
    return None if at is None else others[at][0]


def decide(first: list[Seen], second: list[Seen]) -> tuple[list[int], list[str]]:
    """Numbers of the lines agreed on, those of ``second`` counted on from ``first``, and messages
    where the engines' digits differ."""
    free = dict(enumerate(second, len(first)))
    chosen, messages = [], []
    for number, own in enumerate(first):
        at = likest(own.text, [(i, other.text) for i, other in free.items() if own.overlap(other) >= LEAST_OVERLAP])
        if at is None:
            chosen.append(number)
            continue
        other = free.pop(at)
        if own.text != other.text and own.digits() != other.digits():
            messages.append(f"цифры расходятся: {own.engine}={own.digits()} vs {other.engine}={other.digits()}")
        elif own.text != other.text and other.conf > own.conf:
            number = at
        chosen.append(number)
    orphans = [i for i, x in free.items() if x.conf >= ORPHAN_CONFIDENCE and all(x.overlap(own) < LEAST_OVERLAP for own in first)]
    return [*chosen, *orphans], messages


def arbitrate(primary: list | None, secondary: list | None) -> dict:
    """Lines agreed on, and messages where the engines' digits differ."""
    first, second = ([] if side is None else list(side) for side in (primary, secondary))
    chosen, messages = decide([_seen(x) for x in first], [_seen(x) for x in second])
    return {"lines": [[*first, *second][i] for i in chosen], "messages": messages}


def seen(side: str) -> Column:
    """What arbitration reads of an array of lines: text, confidences and top and bottom, without a word's box."""

    def of(x: Column, field: str) -> Column:
        return x["words"].getField(field)

    return F.transform(
        side,
        lambda x: F.struct(
            x["engine"].alias("engine"), F.array_join(F.array_remove(of(x, "text"), ""), " ").alias("text"), of(x, "conf").cast("array<double>").alias("confs"),
            F.array_min(of(x, "y0")).cast("int").alias("y0"), F.array_max(of(x, "y1")).cast("int").alias("y1"),
        ),
    )


def _lines_of(side: pa.ListArray) -> Iterator[list[Seen]]:
    """The lines of each page of a column as ``seen`` gives it."""
    lines, size = side.flatten(), side.value_lengths().fill_null(0).to_pylist()
    engines, texts, y0, y1 = (lines.field(i).to_pylist() for i in (0, 1, 3, 4))
    confs = lines.field(2)
    ends = confs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum().tolist()
    values = confs.flatten().to_pandas().tolist()
    at = 0
    for n in size:
        yield [Seen(engines[i], texts[i] or "", _mean(values[ends[i - 1] if i else 0 : ends[i]]), y0[i] or 0, y1[i] or 0) for i in range(at, at + n)]
        at += n


def _decided(rows: DataFrame, pages_at_once: int = 64) -> DataFrame:
    """``rows`` (…, _first, _second as ``seen`` gives them) with ``_chosen`` and ``messages``
    instead of these. Python objects are made for ``pages_at_once`` pages at a time."""
    own = [c for c in rows.columns if c not in ("_first", "_second")]
    schema = T.StructType([*rows.select(*own).schema, T.StructField("_chosen", T.ArrayType(T.IntegerType())), T.StructField("messages", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, pages_at_once):
                part = batch.slice(start, pages_at_once)
                found = [decide(a, b) for a, b in zip(*(_lines_of(part.column(c)) for c in ("_first", "_second")), strict=True)]
                made = [pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *made], [*own, "_chosen", "messages"])

    return rows.select(*own, "_first", "_second").mapInArrow(run, schema)


def decided(pages: DataFrame) -> DataFrame:
    """``pages`` (…, primary, secondary: arrays of lines) with ``chosen`` and ``messages`` instead of
    the lines: numbers of the lines agreed on, from 0, the second engine's after the first's."""
    own = [c for c in pages.columns if c not in ("primary", "secondary")]
    return _decided(pages.select(*own, seen("primary").alias("_first"), seen("secondary").alias("_second"))).withColumnRenamed("_chosen", "chosen")


def agreed(pages: DataFrame) -> DataFrame:
    """``pages`` (…, primary, secondary: arrays of lines) with ``lines`` and ``messages``."""
    rows = _decided(pages.withColumns({"_first": seen("primary"), "_second": seen("secondary")}))
    n = F.coalesce(F.array_size("primary"), F.lit(0))

    def plain(x: Column) -> Column:
        return F.struct(x["engine"].alias("engine"), F.transform(x["words"], lambda w: F.struct(*(w[f.name].cast(f.dataType).alias(f.name) for f in WORD))).alias("words"))

    lines = F.transform("_chosen", lambda i: F.when(i < n, plain(F.get("primary", i))).otherwise(plain(F.get("secondary", i - n))))
    return rows.select(*pages.columns, lines.alias("lines"), "messages")


def disagreements(pages: DataFrame) -> DataFrame:
    """Warnings of pages with messages."""
    return pages.select("doc_id", "page", F.lit("engine_disagreement").alias("type"), F.explode("messages").alias("detail"))
