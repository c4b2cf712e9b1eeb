"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are laid out in equal-token blocks. Sources get integer numbers of blocks by
highest quotients target / (2 q + 1), shards of a source get theirs by the same
rule from their sizes, and each shard selects its blocks from a seeded start.
Only DataFrame functions touch documents; the driver handles one row per source
and per shard, both bounded by parameters.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, settled

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float = 2.0) -> list[float]:
    """Targets that share ``total`` by weight, none above ``cap`` times its size:
    what is over the cap is shared again among the others by weight."""
    targets = [0.0] * len(sizes)
    # Sources reach their cap in the order of size to weight, so one sorted pass settles them.
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    left, weight = float(total), float(sum(weights))
    for at, i in enumerate(order):
        if left * weights[i] <= cap * sizes[i] * weight:
            share = left / weight
            for k in order[at:]:
                targets[k] = min(share * weights[k], cap * float(sizes[k]))
            break
        targets[i] = cap * float(sizes[i])
        left, weight = left - targets[i], weight - weights[i]
    return targets


def apportion(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Sainte-Laguë quotas: seats go one by one to the highest votes / (2 q + 1),
    ties to the first, none beyond its cap. A divisor found by bisection hands
    out all but a few at once, so the cost doesn't depend on the seats."""
    limit, weight = np.array(caps, np.int64), np.array(votes, np.float64)
    seats = min(seats, int(limit[weight > 0].sum()))

    def given(rate: float) -> np.ndarray:
        return np.minimum(limit, np.floor(weight * rate + 0.5)).astype(np.int64)

    low, high = 0.0, 1.0
    while given(high).sum() < seats:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if given(mid).sum() <= seats else (low, mid)
    # A little under the divisor, so that rounding gives nobody a seat that a tie has to decide.
    quotas = given(low * (1 - 1e-9)).tolist()
    heap = [(-v / (2 * q + 1), i) for i, (v, q, c) in enumerate(zip(votes, quotas, caps, strict=True)) if q < c and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(quotas)):
        _, i = heapq.heappop(heap)
        quotas[i] += 1
        if quotas[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * quotas[i] + 1), i))
    return quotas


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    max_repeats: int = 2,
    seed: int = 20,
    shard_rows: int = 1024,
    max_shards: int = 100_000,
    max_sources: int = 1_000_000,
) -> DataFrame:
    """Words to take from each row of ``docs`` (doc_id, text, source).

    Sources in code point order, null last, have ``weights`` in turn and share
    ``share`` times all words, none more than ``max_repeats`` times its own. A
    source is dealt by hash into shards of about ``shard_rows`` rows (more rows a
    shard where that would make over ``max_shards``), so a source with a third of
    all rows is many small windows. A shard lays its rows out in hash order; its
    quota of blocks is whole passes plus a run of blocks from a seeded start, so
    no document is taken more than ``max_repeats`` times.

    Null text counts 0 words and takes 0; null or repeated doc_id are rows like
    any others; an empty table gives no rows. Other columns are not read.
    Returns doc_id, source, size, source_size, target, taken. Raises ValueError
    beyond ``max_sources`` different sources.
    """
    spark = docs.sparkSession
    sized = settled(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text", "doc_id", F.lit(seed)).alias("at")),
        "mix-sizes",
    )
    counted = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).limit(max_sources + 1).collect()
    if len(counted) > max_sources:
        raise ValueError(f"over {max_sources} sources")
    counted.sort(key=lambda r: (r.source is None, r.source or ""))
    words, n_rows = [r.words for r in counted], [r.rows for r in counted]
    targets = water_fill(words, [weights[i % len(weights)] for i in range(len(words))], share * sum(words), max_repeats)
    block = max(1, min([256, *(w // 1024 for w in words if w)]))
    shard_rows = max(shard_rows, math.ceil(sum(n_rows) / max_shards))
    source_rows = [(i, r.source, words[i], targets[i], math.ceil(n_rows[i] / shard_rows)) for i, r in enumerate(counted)]
    sources = spark.createDataFrame(source_rows, "sid int, source_name string, source_size long, target double, shards int")
    placed = sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name").withColumn("shard", F.pmod(F.xxhash64("at", F.lit(seed + 1)), F.col("shards")).cast("int"))

    shards = sorted(tuple(r) for r in placed.groupBy("sid", "shard").agg(F.sum("size").alias("words")).collect())
    of_source: dict[int, list[tuple[int, int]]] = {}
    for sid, shard, n in shards:
        of_source.setdefault(sid, []).append((shard, n))
    blocks = {(sid, shard): -(-n // block) for sid, shard, n in shards}
    room = [max_repeats * sum(blocks[sid, shard] for shard, _ in of_source.get(sid, [])) for sid in range(len(words))]
    quotas = apportion(targets, round(sum(targets) / block), room)
    plan = []
    for sid, own in of_source.items():
        given = apportion([float(n) for _, n in own], quotas[sid], [max_repeats * blocks[sid, shard] for shard, _ in own])
        for (shard, n), q in zip(own, given, strict=True):
            count = blocks[sid, shard]
            passes, rest = divmod(q, count) if count else (0, 0)
            start = zlib.crc32(f"{seed}/{sid}/{shard}".encode()) % max(1, count) * block
            plan.append((sid, shard, n, passes, start, rest * block, count * block))
    plan_df = spark.createDataFrame(plan, "sid int, shard int, shard_size long, passes long, first long, run long, ring long")

    order = Window.partitionBy("sid", "shard").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("begin", F.coalesce(F.sum("size").over(order), F.lit(0))).join(F.broadcast(plan_df), ["sid", "shard"])
    end = F.col("begin") + F.col("size")

    def overlap(low, high):
        return F.greatest(F.lit(0), F.least(end, high) - F.greatest(F.col("begin"), low))

    # The run of blocks may go round the end of the shard: it continues from its start.
    stop = F.col("first") + F.col("run")
    extra = overlap(F.col("first"), F.least(stop, F.col("ring"))) + overlap(F.lit(0), stop - F.col("ring"))
    taken = F.col("passes") * F.col("size") + extra
    return laid.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
