"""Stupid-backoff scores from character n-gram counts of the whole corpus.

Documents are dealt by hash into blocks. Each block explodes its texts into
five-character grams and counts the different ones, so a very common gram is one row
a block. Counts are summed by gram (tables partitioned by its hash), shorter orders
come from the longer ones by aggregation, and each gram's score by joins from one
order to the next. The scores are joined back to the grams of each block and summed
over the positions of each of its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import blocks_for, settled, shuffle_partitions

ORDER, START = 5, "\x02"


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of each ORDER characters in a row."""
    n = len(codes) - ORDER + 1
    key = np.zeros(max(0, n), np.uint64)
    for i in range(ORDER):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(key)].astype(np.uint64) + np.uint64(1)
    return words.mix(key)


def _laid(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts, each after four start signs; hashes of the gram ending at each real
    character; number of characters of each text."""
    joined = START * (ORDER - 1) + (START * (ORDER - 1)).join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begins = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    real = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)
    return joined, gram_hashes(codes)[real], real


def _pieces(column: pa.ChunkedArray, limit: int = 1 << 21):
    """Texts of a block in lists of about ``limit`` characters."""
    part, size = [], 0
    for t in column:
        own = t.as_py() or ""
        if part and size + len(own) > limit:
            yield part
            part, size = [], 0
        part.append(own)
        size += len(own)
    if part:
        yield part


def _count(key, table):
    """(block, gram, n): the different grams of one block."""
    seen = np.zeros(0, np.uint64)
    total = np.zeros(0, np.int64)
    names = np.zeros(0, object)
    for texts in _pieces(table.column("text")):
        joined, found, real = _laid(texts)
        own, first, n = np.unique(found, return_index=True, return_counts=True)
        own_names = np.array([joined[i : i + ORDER] for i in real[first].tolist()] + [""], object)[:-1]
        both, at = np.unique(np.concatenate([seen, own]), return_inverse=True)
        total, old = np.bincount(at, weights=np.concatenate([total, n]), minlength=len(both)).astype(np.int64), names
        names = np.empty(len(both), object)
        names[at] = np.concatenate([old, own_names])
        seen = both
    block = key[0].as_py()
    return pa.table({"block": pa.array(np.full(len(seen), block, np.int32)), "gram": pa.array(names.tolist(), pa.string()), "n": pa.array(total)})


def _score(key, docs, grams):
    """Sums of each document of one block."""
    names, logs = grams.column("gram").to_pylist(), grams.column("log_score").to_numpy()
    order = np.zeros(0, np.int64)
    if names:
        codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
        key_of = gram_hashes(np.concatenate([codes.ravel(), np.zeros(0, np.uint32)]))[::ORDER]
        order = np.argsort(key_of)
        key_of, logs = key_of[order], logs[order]
    sums, sizes = [], []
    for texts in _pieces(docs.column("text")):
        _, found, _ = _laid(texts)
        n = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        upto = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(key_of, found)])]) if len(found) else np.zeros(1)
        ends = np.cumsum(n)
        sums.append(upto[ends] - upto[ends - n])
        sizes.append(n)
    n, total = np.concatenate(sizes), np.concatenate(sums)
    return pa.table({"doc_id": docs.column("doc_id"), "n_chars": pa.array(n), "log_score": pa.array(np.where(n > 0, total, 0.0))})


def gram_scores(counts: DataFrame, backoff: float, least_count: int) -> DataFrame:
    """(gram, log_score) of each five-character gram of ``counts`` (gram, n).

    S(c | context) is n(context c) / n(context) if the gram occurs ``least_count`` times
    at least, else ``backoff`` times S(c | context without its first character); for
    a single character it is its share of all.
    """
    shorter = None
    for k in range(1, ORDER + 1):
        own = counts.groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(F.sum("n").alias("n"))
        if k == 1:
            whole = counts.agg(F.sum("n").alias("n")).first().n or 1
            shorter = own.select("gram", (F.col("n") / F.lit(whole)).alias("score"))
            continue
        own = settled(own.withColumn("context", F.left("gram", F.lit(k - 1))).withColumn("tail", F.right("gram", F.lit(k - 1))), f"lm-{k}")
        contexts = own.groupBy("context").agg(F.sum("n").alias("of"))
        own = own.join(contexts, "context").join(shorter.withColumnsRenamed({"gram": "tail", "score": "less"}), "tail")
        score = F.when(F.col("n") >= least_count, F.col("n") / F.col("of")).otherwise(F.lit(backoff) * F.col("less"))
        shorter = settled(own.select("gram", score.alias("score")), f"lm-score-{k}")
    return shorter.select("gram", F.log("score").alias("log_score"))


def score(docs: DataFrame, backoff: float = 0.4, least_count: int = 2, block_mb: float = 3.0) -> DataFrame:
    """Stupid-backoff score of each row of ``docs`` (doc_id, text) under counts of all of
    them: doc_id, n_chars, log_score (sum over characters), mean_log_score.

    Every character is scored after up to four before it (start signs at the
    beginning). A null or empty text has n_chars 0, log_score 0 and a null mean. Rows
    with null or equal doc_id, and equal rows, are each scored (and counted). Other
    columns are not read; an empty table gives no rows.
    """
    n = blocks_for(docs.sparkSession, docs.select("text"), block_mb, shuffle_partitions(docs.sparkSession))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"))
    grams = settled(rows.groupBy("block").applyInArrow(_count, "block int, gram string, n long"), "lm-grams")
    counts = settled(grams.groupBy("gram").agg(F.sum("n").alias("n")), "lm-counts")
    scores = gram_scores(counts, backoff, least_count)
    known = grams.select("block", "gram").join(scores, "gram")
    found = rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score, "doc_id long, n_chars long, log_score double")
    return found.withColumn("mean_log_score", F.when(F.col("n_chars") > 0, F.col("log_score") / F.col("n_chars")))
