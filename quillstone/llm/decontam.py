"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages of 64 words, one beginning every 32. Passages are
TF-IDF vectors over the words of the benchmark; a randomised SVD over the passages of all
documents, in one pass, gives a latent space, and passages close to a benchmark item there are
candidates. A candidate is confirmed by the longest common subsequence of the
item's words and the text around the passage, and by the item's answer (its end).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import fresh

HALF = 32  # words; a passage is two of these
#: Candidates have at least this cosine; confirmed ones this share of the item's
#: words in order, or the lower share and the answer.
COSINE, COPIED, REWORDED, ANSWERED = 0.4, 0.8, 0.6, 0.8
HITS = "array<struct<item_id:long,cosine:double,common_words:long,item_words:long,answer:boolean>>"


def _tokens(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and hashes of lower-cased alphanumeric words of each text."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    for lo, hi in words.chunks(raw):
        found, sizes = words.hashes(raw[lo:hi], words.NOT_ALPHANUMERIC)
        at = 0
        for i, n in enumerate(sizes):
            yield lo + i, found[at : at + n]
            at += n


class Lookup:
    """Numbers of words in a sorted vocabulary, by a table over the first bits of their hashes."""

    BITS = 20

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        first = (vocabulary >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.table = np.full(1 << self.BITS, -1, np.int32)
        self.table[first[::-1]] = np.arange(len(vocabulary), dtype=np.int32)[::-1]
        self.longest = int(np.bincount(first).max()) if len(first) else 0

    def __call__(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that are in the vocabulary, and their numbers there."""
        slot = self.table[(found >> np.uint64(64 - self.BITS)).astype(np.int64)]
        at = np.flatnonzero(slot >= 0)
        number, own = slot[at].astype(np.int64), found[at]
        same = self.vocabulary[number] == own if len(at) else np.zeros(0, bool)
        for k in range(1, self.longest):  # words with the same first bits are neighbours
            other = np.minimum(number + k, len(self.vocabulary) - 1)
            new = ~same & (self.vocabulary[other] == own)
            number[new], same = other[new], same | new
        return at[same], number[same]


def lookup(vocabulary: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``Lookup`` of one text."""
    return Lookup(vocabulary)(found)


@dataclass
class Latent:
    """What a task needs to search: vocabulary, projection, items."""

    vocabulary: np.ndarray  # sorted word hashes
    projection: np.ndarray  # vocabulary x rank, rows times idf
    pieces: np.ndarray  # item pieces x rank, unit length
    piece_item: list[int]
    items: list[tuple[int, list[int]]]  # item_id, word hashes

    def __post_init__(self) -> None:
        self._plan = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_plan": None}

    @property
    def plan(self) -> Plan:
        if self._plan is None:
            self._plan = Plan(self)
        return self._plan


class Plan:
    """What a search derives from a ``Latent`` once: bits of the items, and how many words of an
    item a stretch of text must have at least before the item can be confirmed there."""

    def __init__(self, latent: Latent):
        self.lookup = Lookup(latent.vocabulary)
        self.bits = [(_places(w), _places(answer_of(w)), len(answer_of(w))) for _, w in latent.items]
        self.sizes = np.array([len(w) for _, w in latent.items])
        own = [self.lookup(np.array(w, np.uint64))[1] for _, w in latent.items]
        least = np.where(self.sizes >= 8, REWORDED, COPIED) * self.sizes
        # Words without weight aren't counted: any of them may be there.
        self.needed = np.ceil(least - 1e-9).astype(np.int64) - (self.sizes - np.array([len(k) for k in own]))
        self.reach = -(-self.sizes // HALF)
        pairs = sorted({(int(k), i) for i, numbers in enumerate(own) for k in numbers})
        self.of_word = np.array([i for _, i in pairs], np.int64)
        self.first = np.searchsorted(np.array([k for k, _ in pairs], np.int64), np.arange(len(latent.vocabulary) + 1))
        self.piece_item = np.array(latent.piece_item, np.int64)

    def possible(self, half: np.ndarray, number: np.ndarray, width: int) -> np.ndarray:
        """(passages x items) whether enough of the item's words are around the passage and one is in
        it: ``number`` are words in the halves ``half`` of ``width``, of which passage p covers p and p + 1."""
        n, count = len(self.sizes), self.first[number + 1] - self.first[number]
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(self.first[number], count)
        cell = np.bincount(self.of_word[at] * width + np.repeat(half, count), minlength=width * n).reshape(n, width)
        upto, p = np.zeros((n, width + 1), np.int32), np.arange(width)
        np.cumsum(cell, axis=1, out=upto[:, 1:])
        out = np.zeros((n, width), bool)
        for reach in np.unique(self.reach):
            mine = np.flatnonzero(self.reach == reach)
            own = upto[mine]
            around = own[:, np.minimum(p + 2 + reach, width)] - own[:, np.maximum(p - reach, 0)]
            item, row = np.divmod(np.flatnonzero(around >= np.maximum(self.needed[mine], 1)[:, None].astype(np.int32)), width)
            inside = own[item, np.minimum(row + 2, width)] > own[item, row]
            out[mine[item[inside]], row[inside]] = True
        return out.T


def common_words(places: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence; places: bits of each word's positions in the first."""
    full = (1 << n) - 1
    row = full
    for x in other:
        hit = places.get(x)
        if hit:
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return n - row.bit_count()


def _places(item: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(item):
        out[x] = out.get(x, 0) | (1 << i)
    return out


def answer_of(item: list[int]) -> list[int]:
    """The last quarter of an item's words, three at least."""
    return item[-max(3, len(item) // 4) :]


def search(latent: Latent, texts: list[str | None]) -> list[list[tuple]]:
    """Confirmed hits of each text: (item_id, cosine, common_words, item_words, answer).

    Only passages around which some item has as many words as its confirmation takes, and which
    hold a weighted word of it, are projected. That loses none: the longest common subsequence has
    no word that isn't there, and the space holds items whole, so without such a word a cosine is 0.
    """
    best: list[dict[int, tuple]] = [{} for _ in texts]
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    for lo, hi in words.chunks(raw):
        _search_chunk(latent, *words.hashes(raw[lo:hi], words.NOT_ALPHANUMERIC), best[lo:hi])
    return [[(latent.items[i][0], c, k, len(latent.items[i][1]), a) for i, (k, c, a) in sorted(own.items())] for own in best]


def _search_chunk(latent: Latent, found: np.ndarray, sizes: np.ndarray, best: list[dict[int, tuple]], slab: int = 2048) -> None:
    """Puts the hits of some texts' words, ``sizes`` of each, into ``best``.

    Halves of all texts are numbered in a row, each text's after an empty one; they are
    handled ``slab`` at a time, so a very long text doesn't need more memory.
    """
    plan = latent.plan
    at, number = plan.lookup(found)
    if not len(at):
        return
    begins = np.cumsum(sizes) - sizes
    halves = sizes // HALF + 2
    base = np.cumsum(halves) - halves + 1  # a text's first half
    text = np.repeat(np.arange(len(sizes)), sizes)[at]
    half = base[text] + (at - begins[text]) // HALF
    total, margin = int(halves.sum()), int(plan.reach.max()) + 1
    for start in range(0, total, slab):
        left = max(0, start - margin)
        low, high = np.searchsorted(half, [left, start + slab + margin + 1])
        if low == high:
            continue
        own_half, own_number = half[low:high] - left, number[low:high]
        possible = plan.possible(own_half, own_number, start + slab + margin + 1 - left)
        possible[: start - left] = False
        possible[start - left + slab :] = False
        passage = np.flatnonzero(possible.any(axis=1))
        if not len(passage):
            continue
        wanted = np.zeros(len(possible) + 1, bool)
        wanted[passage] = wanted[passage + 1] = True
        some = np.flatnonzero(wanted[own_half])
        first = np.flatnonzero(np.diff(own_half[some], prepend=-1))
        here = own_half[some][first]
        sums = np.zeros((len(possible) + 1, latent.projection.shape[1]), np.float32)
        if len(some):
            sums[here] = _sums(latent.projection, own_number[some], first)
        both = sums[passage] + sums[passage + 1]
        norm = np.linalg.norm(both, axis=1, keepdims=True)
        cosine = (both / np.maximum(norm, 1e-9)) @ latent.pieces.T
        for p, piece in zip(*np.divmod(np.flatnonzero((cosine >= COSINE) & possible[passage][:, plan.piece_item]), len(plan.piece_item)), strict=True):
            item = latent.piece_item[piece]
            row = int(np.searchsorted(base - 1, passage[p] + left, "right")) - 1
            n, words_here = int(plan.sizes[item]), int(sizes[row])
            begin = (int(passage[p]) + left - int(base[row])) * HALF
            around = found[begins[row] + max(0, begin - n) : begins[row] + min(words_here, max(0, begin + 2 * HALF + n))].tolist()
            places, answer, m = plan.bits[item]
            # Different words of the item that aren't there are words less.
            if n - len(places) + len(places.keys() & set(around)) < (REWORDED if n >= 8 else COPIED) * n:
                continue
            common = common_words(places, n, around)
            if common < REWORDED * n:
                continue
            answered = common_words(answer, m, around) >= ANSWERED * m
            if common >= COPIED * n or (answered and n >= 8):
                now = (common, float(cosine[p, piece]), answered)
                best[row][item] = max(best[row].get(item, now), now)


def _sums(rows: np.ndarray, number: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Sums of ``rows[number]``, times ``weight``, over the short runs that begin at ``first``: the first of every run, then the second ..."""
    size = np.diff(first, append=len(number))
    order = np.argsort(-size, kind="stable")
    begin, longest = first[order], -size[order]
    out = np.zeros((len(first), rows.shape[1]), rows.dtype)
    for k in range(-int(longest[0]) if len(first) else 0):
        at = begin[: np.searchsorted(longest, -k)] + k
        out[: len(at)] += rows[number[at]] if weight is None else rows[number[at]] * weight[at, None]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back]


def _document_counts(vocabulary: np.ndarray):
    """Task: how many passages each word is in, and (word -1) how many passages there are, (word -2) texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total, texts, find = np.zeros(len(vocabulary), np.int64), 0, 0, Lookup(vocabulary)
        for batch in batches:
            texts += batch.num_rows
            for start in range(0, batch.num_rows, 256):
                raw = [(t or "").lower().encode("utf-8", "replace") for t in batch.column("text").slice(start, 256).to_pylist()]
                for lo, hi in words.chunks(raw):
                    found, sizes = words.hashes(raw[lo:hi], words.NOT_ALPHANUMERIC)
                    halves = sizes // HALF + 1
                    total += int(halves.sum())
                    at, number = find(found)
                    # Halves of all texts in a row with an empty one between them.
                    text = np.repeat(np.arange(len(sizes)), sizes)[at]
                    half = (np.cumsum(halves + 1) - halves)[text] + (at - (np.cumsum(sizes) - sizes)[text]) // HALF
                    cell = np.sort(half * len(vocabulary) + number, kind="stable")
                    different = cell[np.diff(cell, prepend=-1) > 0]
                    half, number = different // max(1, len(vocabulary)), different % max(1, len(vocabulary))
                    # A word in n halves is in 2 n passages, less one for each two neighbouring halves.
                    counts += 2 * np.bincount(number, minlength=len(vocabulary))
                    if len(different):
                        after = np.minimum(np.searchsorted(different, different + len(vocabulary)), len(different) - 1)
                        counts -= np.bincount(number[different[after] == different + len(vocabulary)], minlength=len(vocabulary))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(counts[some], [total, texts]))], ["word", "passages"])

    return run


def _add_products(out: np.ndarray, find: Lookup, idf: np.ndarray, right: np.ndarray, found: np.ndarray, sizes: np.ndarray, slab: int = 2048) -> None:
    """Adds A' A right to ``out``, A being the unit TF-IDF rows of all passages of some texts, ``sizes``
    words of each in ``found``. Handled ``slab`` halves or as many words at a time, whatever a text's length."""
    at, number = find(found)
    if not len(at):
        return
    n = len(idf)
    # Halves of all texts in a row with an empty one before each; passage p is of the halves p and p + 1.
    text = np.repeat(np.arange(len(sizes)), sizes)[at]
    halves = sizes // HALF + 1
    half = (np.cumsum(halves + 1) - halves)[text] + (at - (np.cumsum(sizes) - sizes)[text]) // HALF
    cell, tf = np.unique(half * n + number, return_counts=True)
    half, number = cell // n, cell % n
    weight = (tf * idf[number]).astype(np.float32)
    width = int(half[-1]) + 2
    here, first = np.unique(half, return_index=True)
    sums, ends = np.zeros((width, right.shape[1]), np.float32), np.append(first, len(cell))
    for lo in range(0, len(here), slab):
        hi = min(lo + slab, len(here))
        own = slice(ends[lo], ends[hi])
        sums[here[lo:hi]] = _sums(right, number[own], first[lo:hi] - ends[lo], weight[own])
    # The square of a passage's length: those of its halves, and twice what words in both have in common.
    square = np.bincount(half, weight.astype(np.float64) ** 2, width)
    after = np.minimum(np.searchsorted(cell, cell + n), len(cell) - 1)
    both = np.flatnonzero(cell[after] == cell + n)
    square[:-1] += square[1:] + np.bincount(half[both], 2.0 * weight[both] * weight[after[both]], width)[:-1]
    sums[:-1] += sums[1:]
    sums /= np.maximum(square, 1e-12)[:, None].astype(np.float32)
    sums[1:] += sums[:-1].copy()
    order = np.argsort(number, kind="stable")
    for lo in range(0, len(order), HALF * slab):
        some = order[lo : lo + HALF * slab]
        start = np.flatnonzero(np.diff(number[some], prepend=-1))
        out[number[some][start]] += np.add.reduceat(weight[some, None] * sums[half[some]], start, axis=0)


def products(docs: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A' A right, A being the passages of all of ``docs`` (text): each task sums those of its texts, then rows are summed by number."""
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, idf, right.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf, right = held.value
        out, find = np.zeros(right.shape), Lookup(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                raw = [(t or "").lower().encode("utf-8", "replace") for t in batch.column("text").slice(start, 256).to_pylist()]
                for lo, hi in words.chunks(raw):
                    _add_products(out, find, idf, right, *words.hashes(raw[lo:hi], words.NOT_ALPHANUMERIC))
        some = np.flatnonzero(np.abs(out).sum(axis=1))
        for lo in range(0, len(some), 1000):
            part = some[lo : lo + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([out[i].tobytes() for i in part], pa.binary())], ["number", "line"])

    def add(key, batch):
        # Sorted: the order in which tasks end is none of the result's.
        lines = np.stack([np.frombuffer(x) for x in sorted(batch.column("line").to_pylist())]).sum(axis=0)
        return pa.table({"number": pa.array([key[0].as_py()], pa.int64()), "line": pa.array([lines.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(run, "number long, line binary").groupBy("number").applyInArrow(add, "number long, line binary")
    total = np.zeros(right.shape)
    for r in parts.toLocalIterator():
        total[r.number] = np.frombuffer(r.line)
    return total


def principal(start: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Approximate singular vectors of A from ``product`` = A' A start (randomised, by Nyström): unit columns, the strongest first."""
    core = start.T @ product
    value, vector = np.linalg.eigh((core + core.T) / 2)
    kept = value > 1e-9 * max(float(value.max(initial=0.0)), 1e-30)
    return np.linalg.svd(product @ (vector[:, kept] / np.sqrt(value[kept])), full_matrices=False)[0]


@dataclass
class Statistics:
    """What the corpus says on the words of all items: passages each is in, passages and texts in all."""

    vocabulary: np.ndarray
    counts: np.ndarray
    total: int
    texts: int


def statistics(docs: DataFrame, items: list[tuple[int, str]], most_words: int = 20_000_000) -> Statistics:
    """Passage counts over all of ``docs`` (text), in one pass, of every word of ``items``; the
    vocabulary is broadcast and bounded by ``most_words`` different words (ValueError beyond)."""
    hashed = [found for _, found in _tokens([t for _, t in items])]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
    if len(vocabulary) > most_words:
        raise ValueError(f"items have over {most_words} different words")
    counts, other = np.zeros(len(vocabulary), np.int64), {}
    for r in docs.select("text").mapInArrow(_document_counts(vocabulary), "word long, passages long").groupBy("word").agg(F.sum("passages").alias("passages")).toLocalIterator():
        if r.word < 0:
            other[r.word] = r.passages
        else:
            counts[r.word] = r.passages
    return Statistics(vocabulary, counts, other.get(-1, 0), other.get(-2, 0))


def unweighted(idf: np.ndarray, common: np.ndarray, items: list[np.ndarray]) -> np.ndarray:
    """Which of the ``common`` words carry no weight: all but those of items that would lose
    more than 40 % of their own weight. Decided on ``common`` as it is, for each item alone."""
    gone = common.copy()
    for number in items:
        if idf[number][~common[number]].sum() < 0.6 * idf[number].sum():
            gone[number] = False
    return gone


def fit(docs: DataFrame, items: list[tuple[int, str]], stop_share: float = 0.05, known: Statistics | None = None) -> Latent | None:
    """Latent space for some benchmark items, or None if they have no words.

    Passage counts for idf cover all of ``docs``; words in over ``stop_share`` of
    the passages carry no weight unless they are over 40 % of an item's weight. The SVD
    is fitted on the items themselves and every passage of ``docs``, in one more pass; the
    space holds every item whole, so a cosine in it is never less than the exact one.
    ``known`` spares the pass that counts.
    """
    hashed = {i: found for (i, _), (_, found) in zip(items, _tokens([t for _, t in items]), strict=True) if len(found)}
    if not hashed:
        return None
    known = known or statistics(docs, items)
    vocabulary = np.unique(np.concatenate(list(hashed.values())))
    counts = known.counts[np.searchsorted(known.vocabulary, vocabulary)]
    idf = np.maximum(np.log((known.total + 2.0) / (counts + 1.0)), 0.1).astype(np.float32)
    gone = unweighted(idf, counts > stop_share * known.total, [np.searchsorted(vocabulary, found) for found in hashed.values()])
    vocabulary, idf = vocabulary[~gone], idf[~gone]

    pieces, piece_item = [], []
    names, find = list(hashed), Lookup(vocabulary)
    for k, i in enumerate(names):
        found = hashed[i]
        for lo in range(0, max(1, len(found) - HALF), 2 * HALF):
            pieces.append(found[lo : lo + 2 * HALF])
            piece_item.append(k)
    dense = np.zeros((len(pieces), len(vocabulary)), np.float32)
    for k, found in enumerate(pieces):
        _, number = find(found)
        np.add.at(dense[k], number, idf[number])
    unit = dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)

    # The items span a part of the space, so none of an item is lost in it; passages add up to 64 directions.
    # Cosines depend on the space alone, not on the axes in it.
    start = np.random.default_rng(2).standard_normal((len(vocabulary), min(len(vocabulary), 64))).astype(np.float32).astype(np.float64)
    spread = principal(start, products(docs, vocabulary, idf, start) + unit.T @ (unit @ start))
    basis = np.linalg.qr(np.concatenate([unit.T, spread], axis=1))[0].astype(np.float32)
    latent = dense @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return Latent(vocabulary, basis * idf[:, None], latent, piece_item, [(i, hashed[i].tolist()) for i in names])


def _hits_udf(held):
    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        out = []
        for lo in range(0, len(texts), 256):
            part = [None if t is None else t for t in texts.iloc[lo : lo + 256]]
            for found in search(held.value, part):
                out.append([dict(zip(("item_id", "cosine", "common_words", "item_words", "answer"), f, strict=True)) for f in found])
        return pd.Series(out, dtype=object)

    return hits


def blocks_of_items(items: list[tuple[int, str]], words_at_once: int, items_at_once: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``items_at_once`` and ``words_at_once`` words."""
    block, size = [], 0
    for i, t in items:
        n = len(next(_tokens([t]))[1])
        if n > words_at_once:
            raise ValueError(f"an item of {n} words: cut it into items of {words_at_once} at most")
        if block and (size + n > words_at_once or len(block) >= items_at_once):
            yield block
            block, size = [], 0
        block.append((i, t))
        size += n
    if block:
        yield block


def with_hits(docs: DataFrame, benchmark: DataFrame, items_at_once: int = 400, words_at_once: int = 20_000, most_items: int = 1_000_000) -> DataFrame:
    """``docs`` (text, ...) with ``hits``: an array of the benchmark items (item_id, text) found
    in the text, with cosine, common_words, item_words and whether the answer is there.

    Every whole text is searched for all items, ``items_at_once`` and ``words_at_once`` words of them
    at a time (which bounds what is broadcast); no text is shuffled. One pass counts the words of
    all items, one for every block of them is its SVD, each over all of ``docs``. Null or empty texts and items
    have no hits; an item under 8 words counts only with 80 % of its words; equal
    rows have equal hits; repeated and null item_id are found each for itself. Raises
    ValueError beyond ``most_items`` items, or for one of over ``words_at_once`` words. Other
    columns pass through, one named hits is replaced; an empty table gives no rows.
    """
    spark = docs.sparkSession
    listed = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chosen = sorted(((r.item_id, r.text) for r in listed.limit(most_items + 1).toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    if len(chosen) > most_items:
        raise ValueError(f"over {most_items} items")
    docs = docs.drop("hits")
    items = list(enumerate(t for _, t in chosen))
    known = statistics(docs, items) if items else None
    columns = []
    for block in blocks_of_items(items, words_at_once, items_at_once):
        latent = fit(docs, block, known=known)
        if latent is None:
            continue
        latent.items = [(chosen[k][0], found) for k, found in latent.items]
        columns.append(_hits_udf(spark.sparkContext.broadcast(latent))("text"))
    if not columns:
        return docs.withColumn("hits", F.array().cast(HITS))
    names = fresh(docs.columns, *(f"hits{i}" for i in range(len(columns))))
    found = docs.withColumns(dict(zip(names, columns, strict=True)))
    return found.withColumn("hits", F.concat(*names)).drop(*names)
