"""Substring dedup: repeated passages located by sharded Aho-Corasick automata.

1. Every run of ``WINDOW`` words names its least ``GRAM``-word hash (a minimizer).
   Equal runs name equal hashes, so only runs whose minimizer occurs in two
   documents can recur; a few hashes a document are counted instead of all runs.
2. Runs with such a minimizer are hashed and counted: those that start in two
   documents are confirmed, with the least doc_id they start in, their owner.
3. Stretches of confirmed runs in their owners are the passages. Each block of
   documents gets the passages of the owners its documents share runs with, and
   compiles them into automata of bounded size (aligned pieces of half a window:
   every run of a window holds a whole one). All the block's documents that hold
   confirmed runs are streamed through the automata; each hit is extended word by
   word, and stretches of at least a window are what has been seen before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import WORD, blocks_for, settled, shuffle_partitions

WINDOW, GRAM = 50, 8
PIECE = WINDOW // 2
#: Words of passages that one automaton holds at most (a single passage is never cut).
AUTOMATON_WORDS = 1_000_000
NULL_ID = 2**63 - 1

_word = re.compile(WORD)


def _minimizers(word_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of WINDOW words of one text: the place of its minimizer; and all gram hashes."""
    grams = words.windows(word_hashes, GRAM)
    span = WINDOW - GRAM + 1
    n = len(word_hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), grams
    # High bits of the hash, then the place: the least is the leftmost of the least hashes.
    bits = max(1, int(len(grams)).bit_length())
    key = (grams >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(grams), dtype=np.uint64)
    least, width = key, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    return (least & np.uint64((1 << bits) - 1)).astype(np.int64), grams


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _by_text(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and word hashes of each text, a few texts at a time."""
    for start in range(0, len(column), 128):
        raw = _texts(column.slice(start, 128))
        for lo, hi in words.chunks(raw):
            found, sizes = words.hashes(raw[lo:hi], words.SPACES)
            at = 0
            for i, n in enumerate(sizes):
                yield start + lo + i, found[at : at + n]
                at += n


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different minimizers of each document: (seed, doc)."""
    for batch in batches:
        ids = batch.column("doc").to_numpy()
        seeds, owners = [], []
        for row, found in _by_text(batch.column("text")):
            place, grams = _minimizers(found)
            if len(place):
                own = np.unique(grams[np.unique(place)])
                seeds.append(own)
                owners.append(np.full(len(own), ids[row]))
        if seeds:
            yield _batch(["seed", "doc"], np.concatenate(seeds).view(np.int64), np.concatenate(owners))


def _digest(found: list[str]) -> str:
    return hashlib.sha256(" ".join(found).encode("utf-8", "surrogatepass")).hexdigest()


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without a recurring minimizer are done; the others keep their text."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            counts, digests = [], []
            for t, seeds in zip(part.column("text").to_pylist(), part.column("seeds").to_pylist(), strict=True):
                own = _word.findall(t or "")
                counts.append(len(own))
                digests.append(None if seeds else _digest(own))
            texts = [t if d is None else None for t, d in zip(part.column("text").to_pylist(), digests, strict=True)]
            seeds = pa.array([s if d is None else None for s, d in zip(part.column("seeds").to_pylist(), digests, strict=True)], pa.list_(pa.int64()))
            yield _batch(["doc_id", "doc", "text", "seeds", "n_words", "kept_sha256"], part.column("doc_id"), part.column("doc"), pa.array(texts, pa.string()), seeds, pa.array(counts, pa.int64()), pa.array(digests, pa.string()))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with a recurring minimizer: (run, doc, place)."""
    for batch in batches:
        ids, seeds = batch.column("doc").to_numpy(), batch.column("seeds")
        for row, found in _by_text(batch.column("text")):
            place, grams = _minimizers(found)
            if not len(place):
                continue
            wanted = np.isin(grams.view(np.int64), np.asarray(seeds[row].values))
            at = np.flatnonzero(wanted[place])
            if len(at):
                run = words.windows(found, WINDOW)[at].view(np.int64)
                yield _batch(["run", "doc", "place"], run, np.full(len(at), ids[row]), at.astype(np.int32))


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of owners from (doc, text, places): stretches of the runs that begin at places."""
    for batch in batches:
        owners, texts = [], []
        for doc, text, places in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
            own, at = _word.findall(text or ""), np.sort(np.array(places))
            for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                owners.append(doc)
                texts.append(" ".join(own[part[0] : part[-1] + WINDOW]))
        yield _batch(["owner", "passage"], pa.array(owners, pa.int64()), pa.array(texts, pa.string()))


class Automaton:
    """Aho-Corasick automaton over words (as characters) for pieces of passages."""

    def __init__(self, passages: list[tuple[int, str]]):
        self.code: dict[str, str] = {}
        self.passages = []
        self.machine = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for number, (owner, text) in enumerate(passages):
            own = "".join(self._char(w) for w in text.split(" "))
            self.passages.append((owner, own))
            for at in range(0, len(own) - PIECE + 1, PIECE):
                pieces.setdefault(own[at : at + PIECE], []).append((number, at))
        for piece, places in pieces.items():
            self.machine.add_word(piece, places)
        self.machine.make_automaton()

    def _char(self, word: str) -> str:
        known = self.code.get(word)
        if known is None:
            n = len(self.code) + 1
            known = self.code[word] = chr(n if n < 0xD800 else n + 0x800)
        return known

    def seen(self, doc: int, own: list[str]) -> list[tuple[int, int]]:
        """Stretches [begin, end) of the document's words that a passage of an earlier owner holds."""
        get = self.code.get
        line = "".join([get(w, "\0") for w in own])
        found, done = [], {}
        if not len(self.machine):
            return found
        for last, places in self.machine.iter(line):
            at = last - PIECE + 1
            for number, offset in places:
                owner, text = self.passages[number]
                if owner >= doc or done.get((number, at - offset), -1) > last:
                    continue
                begin = at - _common(line[:at][::-1], text[:offset][::-1])
                end = last + 1 + _common(line[last + 1 :], text[offset + PIECE :])
                done[number, at - offset] = end
                if end - begin >= WINDOW:
                    found.append((begin, end))
        return found


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving the unequal part."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is equal, a[:high] isn't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def automata(passages: list[tuple[int, str]], most: int = AUTOMATON_WORDS) -> Iterator[Automaton]:
    """Shards of passages of about ``most`` words, each compiled when its turn comes."""
    shard, size = [], 0
    for p in passages:
        n = p[1].count(" ") + 1
        if shard and size + n > most:
            yield Automaton(shard)
            shard, size = [], 0
        shard.append(p)
        size += n
    if shard:
        yield Automaton(shard)


def _located(key, docs: pa.Table, passages: pa.Table) -> pa.Table:
    """Seen stretches of one block's documents: (row, stretches as begin, end, begin, end, ...)."""
    shards = list(zip(passages.column("owner").to_pylist(), passages.column("passage").to_pylist(), strict=True))
    ids, texts = docs.column("doc").to_pylist(), docs.column("text")
    found: list[list[tuple[int, int]]] = [[] for _ in ids]
    for machine in automata(shards):
        for i, doc in enumerate(ids):
            found[i] += machine.seen(doc, _word.findall(texts[i].as_py() or ""))
    removed, digests = [], []
    for i in range(len(ids)):
        own = _word.findall(texts[i].as_py() or "")
        gone = np.zeros(len(own) + 1, np.int32)
        for begin, end in found[i]:
            gone[begin] += 1
            gone[end] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        removed.append(int(gone.sum()))
        digests.append([w for w, g in zip(own, gone.tolist(), strict=True) if not g])
    kept = [" ".join(d) for d in digests]
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": docs.column("n_words"), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})


def remove_repeats(docs: DataFrame, block_mb: float = 2.0) -> DataFrame:
    """Words of each row of ``docs`` (doc_id, text) that stay: doc_id, n_words, n_removed, kept_sha256, kept.

    A word goes if it is in a run of 50 words (split at ASCII white space, compared
    unchanged) that also starts in a row with a smaller doc_id; runs are judged on
    the input. ``kept`` is the kept words joined by one space where any word went,
    else null (the words are those of the text); kept_sha256 is its SHA-256 always.

    Null text has no words. A null doc_id counts as larger than all others; rows
    with the same doc_id don't remove each other's words. Texts under 50 words
    stay. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), "text")
    seeds = settled(rows.select("doc", "text").mapInArrow(_seeds, "seed long, doc long"), "repeat-seeds")
    common = seeds.groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("seed")
    common = settled(common, "repeat-common")
    of_doc = seeds.join(common, "seed").groupBy("doc").agg(F.collect_set("seed").alias("seeds"))
    sorted_schema = "doc_id long, doc long, text string, seeds array<long>, n_words long, kept_sha256 string"
    first = settled(rows.withColumn("doc_id", F.col("doc_id").cast("long")).join(of_doc, "doc", "left").select("doc_id", "doc", "text", "seeds").mapInArrow(_sorted_out, sorted_schema), "repeat-sorted")
    open_ = first.filter("kept_sha256 is null")

    runs = settled(open_.select("doc", "text", "seeds").mapInArrow(_runs, "run long, doc long, place int"), "repeat-runs")
    owned = runs.groupBy("run").agg(F.min("doc").alias("owner"), F.max("doc").alias("b")).filter("owner < b").select("run", "owner")
    shared = settled(runs.join(settled(owned, "repeat-owned"), "run").select("doc", "place", "owner"), "repeat-shared")
    places = shared.filter("doc = owner").groupBy("doc").agg(F.collect_set("place").alias("places"))
    passages = settled(open_.select("doc", "text").join(places, "doc").mapInArrow(_owned, "owner long, passage string"), "repeat-passages")

    n = blocks_for(spark, open_, block_mb, shuffle_partitions(spark))
    block = F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int")
    asked = shared.filter("owner < doc").select("doc", "owner").distinct()
    asking = asked.select("doc").distinct()
    texts = open_.join(asking, "doc").select(block.alias("block"), "doc_id", "doc", "text", "n_words")
    needed = settled(asked.select(block.alias("block"), "owner").distinct(), "repeat-needed").join(passages, "owner").select("block", "owner", "passage").distinct()
    located = texts.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(_located, "doc_id long, n_words long, n_removed long, kept string")
    located = located.withColumns({"kept_sha256": F.sha2("kept", 256)})
    # Minimizers may recur without any confirmed run: these documents stay whole.
    whole = open_.join(asking, "doc", "left_anti").mapInArrow(_whole, "doc_id long, n_words long, kept_sha256 string")
    done = first.filter("kept_sha256 is not null").select("doc_id", "n_words", "kept_sha256").unionByName(whole)
    done = done.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    return done.unionByName(located.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [_digest(_word.findall(t or "")) for t in batch.column("text").to_pylist()]
        yield _batch(["doc_id", "n_words", "kept_sha256"], batch.column("doc_id"), batch.column("n_words"), pa.array(digests, pa.string()))
