"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A sketch of a text takes the ``TUPLE`` k-mers of words with the least hashes (k-mers
labelled with the number of their occurrence) and hashes them in text order. Texts with
an equal sketch number are candidates; texts of up to ``SHORT`` words also meet in a key of
the words that are left when as many are deleted as may differ, which loses none. Word-level
edit similarity of candidates is computed by a bit-parallel alignment in a band as
wide as the threshold allows.

Texts of ``LEAST`` words and more have ``SKETCHES`` numbers of three-word k-mers, those of under
``FEW`` words have ``FEW_SKETCHES`` of two-word k-mers, so two texts that may be similar always
have numbers of one kind. A pair at 0.8 whose every fifth word differs, the worst case,
keeps 0.4 of its three-word k-mers, a Jaccard index of 0.25: both k-mers of a sketch are
equal with about 0.06, one of all sketches with 0.99. With changes at random places it is
above 0.999.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import fresh, settled

TUPLE, THRESHOLD = 2, 0.8
K, SKETCHES, LEAST = 3, 88, 60
FEW_K, FEW_SKETCHES, FEW = 2, 40, 75
SHARED, SHORT = 1, 14
#: Cells of the word counts that tell texts apart before they are aligned, and as few for a first look.
CELLS, COARSE = 1024, 16
#: Nodes of a bucket that are compared with each other in one task.
BLOCK = 1024


def normal_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased alphanumeric words, and their number in each text."""
    return words.hashes([t.lower().encode("utf-8", "replace") for t in texts], words.NOT_ALPHANUMERIC)


def _order_minhash(word: np.ndarray, begins: np.ndarray, sizes: np.ndarray, k: int, count: int, kind: int) -> np.ndarray:
    """Order MinHash numbers (texts x count) of texts with some words: ``sizes`` from ``begins`` in ``word``."""
    pieces = [words.windows(word[at : at + n], min(k, n)) for at, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
    lengths = np.array([len(p) for p in pieces])
    kmer, starts = np.concatenate(pieces), np.cumsum(lengths) - lengths
    # Occurrence labels: the how-manieth time a k-mer comes up in its text.
    keyed = kmer ^ words.mix(np.repeat(np.arange(len(pieces)), lengths).astype(np.uint64) + np.uint64(1))
    order = np.argsort(keyed, kind="stable")
    new = np.concatenate([[True], keyed[order][1:] != keyed[order][:-1]])
    label = np.zeros(len(kmer), np.uint64)
    label[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    labelled = words.mix(kmer + label * np.uint64(0x9FB21C651E98DF25))
    # The lowest bits of a value are its place, so a minimum tells where it is.
    low = np.uint64((1 << max(1, len(kmer).bit_length())) - 1)
    place, value, top = np.arange(len(kmer), dtype=np.uint64), np.empty(len(kmer), np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.zeros((len(pieces), count), np.uint64)
    factors = words.mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(kind)) | np.uint64(1)
    for s in range(count):
        np.multiply(labelled, factors[s], out=value)
        np.bitwise_and(value, ~low, out=value)
        np.bitwise_or(value, place, out=value)
        chosen = []
        for turn in range(TUPLE):
            least = np.minimum.reduceat(value, starts)
            at = (least & low).astype(np.int64)
            chosen.append(np.where(lengths > turn, at, chosen[0] if chosen else at))
            value[chosen[-1]] = top
        mixed = np.full(len(pieces), words.mix(factors[s : s + 1])[0], np.uint64)
        for row in np.sort(np.stack(chosen), axis=0):
            mixed = words.mix(mixed * np.uint64(0x9E3779B97F4A7C15) + labelled[row])
        out[:, s] = mixed
    return out


def _sketched(word: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (texts x all sketches, int64) of texts with ``sizes`` of the words ``word``, and which
    of them a text has."""
    out = np.zeros((len(sizes), SKETCHES + FEW_SKETCHES), np.uint64)
    has = np.zeros(out.shape, bool)
    begins = np.cumsum(sizes) - sizes
    for some, k, columns, kind in ((sizes >= LEAST, K, slice(0, SKETCHES), 1), ((sizes < FEW) & (sizes > 0), FEW_K, slice(SKETCHES, None), 2)):
        rows = np.flatnonzero(some)
        if len(rows):
            out[rows, columns] = _order_minhash(word, begins[rows], sizes[rows], k, columns.indices(out.shape[1])[1] - columns.start, kind)
            has[rows, columns] = True
    # The numbers of the other kind are equal only for texts with the same words.
    for i in np.flatnonzero(~has.all(axis=1)):
        own = words.windows(word[begins[i] : begins[i] + sizes[i]], int(sizes[i])) if sizes[i] else np.zeros(1, np.uint64)
        out[i, ~has[i]] = words.mix(own[0] + np.flatnonzero(~has[i]).astype(np.uint64))
    return out.view(np.int64), has


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Order MinHash numbers (texts x all sketches, int64) and the numbers of words.

    A text of fewer words than a k-mer is one k-mer of all its words; texts without any
    are equal.
    """
    word, sizes = normal_words(texts)
    return _sketched(word, sizes)[0], sizes


def short_keys(own: np.ndarray) -> list[int]:
    """Keys of a text of up to ``SHORT`` words: hashes of what is left without each choice of
    up to a fifth of them. Two such texts with a similarity of ``THRESHOLD`` share one."""
    n, out = len(own), set()
    if 0 < n <= SHORT:
        for gone in range(int(n * (1 - THRESHOLD) + 1e-9) + 1):
            for at in combinations(range(n), gone):
                left = np.delete(own, at)
                out.add(int(words.mix(words.windows(left, len(left)) ^ np.uint64(0x5851F42D4C957F2D + len(left))).view(np.int64)[0]))
    return sorted(out)


def word_counts(own: np.ndarray) -> bytes:
    """How many words of a text are in each of ``CELLS`` cells of their hashes, 255 at most: a byte
    for each cell or, if that is shorter, two bytes for the cell of each word."""
    cells = (own >> np.uint64(40)).astype(np.int64) % CELLS
    if 2 * len(own) < CELLS:
        return np.sort(cells).astype(np.uint16).tobytes()
    return np.minimum(np.bincount(cells, minlength=CELLS), 255).astype(np.uint8).tobytes()


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if at most ``most``, else most + 1.

    Bit-parallel columns hold only the cells within ``most`` of the diagonal.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    lo, hi = 0, len(b)
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    cut = len(a) - len(b)
    while hi > lo and a[hi - 1 + cut] == b[hi - 1]:
        hi -= 1
    a, b = a[lo : hi + cut], b[lo:hi]
    if not b:
        return len(a) if len(a) <= most else most + 1
    most_here = min(most, len(a))
    width = 2 * most_here + 2
    full = (1 << width) - 1
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    up, down = full ^ ((1 << (width - most_here - 1)) - 1), 0
    score, shift = most_here, most_here + 1 - width
    across = 1 << (width - 2)
    diagonal = 1 << (width - 1)
    limit = 2 * most_here + len(b) - len(a)
    for j, x in enumerate(b):
        hit = places.get(x, 0)
        hit = (hit >> shift if shift >= 0 else hit << -shift) & full
        zero = ((((hit & up) + up) ^ up) | hit | down) & full
        rise = (down | ~(zero | up)) & full
        fall = zero & up
        if j < len(a) - most_here:
            score += not zero & diagonal
            if score > limit:
                return most + 1
        else:
            score += bool(rise & across) - bool(fall & across)
            across >>= 1
        half = zero >> 1
        up = (fall | ~(half | rise)) & full
        down = half & rise
        shift += 1
    return score if score <= most else most + 1


def similar(a: list[int], b: list[int], threshold: float = THRESHOLD) -> bool:
    """Whether 1 - distance / length of the longer is at least the threshold."""
    longer = max(len(a), len(b))
    return longer == 0 or banded_distance(a, b, int(longer * (1 - threshold) + 1e-9)) <= longer * (1 - threshold) + 1e-9


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = ["" if t is None else t for t in part.column("text").to_pylist()]
            counts, keys, cells = [], [], []
            raw = [t.encode("utf-8", "replace") for t in texts]
            for lo, hi in words.chunks(raw):
                word, sizes = normal_words(texts[lo:hi])
                found, has = _sketched(word, sizes)
                counts.append(sizes)
                at = 0
                for size, numbers, some in zip(sizes, found, has, strict=True):
                    own = word[at : at + size]
                    keys.append(np.concatenate([numbers[some], np.array(short_keys(own), np.int64)]))
                    cells.append(word_counts(own))
                    at += size
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(np.concatenate(counts).astype(np.int64)), column, pa.array(cells, pa.binary())], ["doc_id", "digest", "n_words", "keys", "cells"])


def _counted(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word counts of texts, in all cells and in a few."""
    all_ = np.zeros((len(cells), CELLS), np.int16)
    for start in range(0, len(cells), 1024):
        part, here = cells[start : start + 1024], all_[start : start + 1024]
        sizes = np.array([len(c) for c in part])
        by_cell = sizes == CELLS
        here[by_cell] = np.frombuffer(b"".join(c for c in part if len(c) == CELLS), np.uint8).reshape(-1, CELLS)
        own = np.frombuffer(b"".join(c for c in part if len(c) != CELLS), np.uint16)
        rows = np.repeat(np.arange(len(part) - by_cell.sum()), sizes[~by_cell] // 2)
        here[~by_cell] = np.minimum(np.bincount(rows * CELLS + own, minlength=int((~by_cell).sum()) * CELLS), 255).reshape(-1, CELLS)
    return all_, all_.reshape(-1, COARSE, CELLS // COARSE).sum(axis=2)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At least so many words of each row of ``y`` have to be changed into those of ``x``."""
    apart = y - x
    return np.maximum(np.maximum(apart, 0).sum(axis=-1), np.maximum(-apart, 0).sum(axis=-1))


def _own_numbers(nodes: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Sketch numbers (nodes x all sketches) from each node's lists ``numbers`` and ``sketches`` (null for none), and which of them a node has."""
    out, has = np.zeros((len(nodes), SKETCHES + FEW_SKETCHES), np.int64), np.zeros((len(nodes), SKETCHES + FEW_SKETCHES), bool)
    numbers, sketch = nodes.field("numbers"), nodes.field("sketches").flatten().to_numpy()
    at = np.repeat(np.arange(len(nodes)), numbers.value_lengths().fill_null(0).to_numpy())
    out[at, sketch], has[at, sketch] = numbers.flatten().to_numpy(), True
    return out, has


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b) of different roots between two blocks of a bucket (or within one) whose numbers
    of words and word counts allow the threshold; only those leave the task, and of all
    buckets that a pair has in common only the first sketch's names it."""
    for batch in batches:
        for value, nodes, i, j in zip(batch.column("value").to_pylist(), batch.column("nodes"), batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True):
            flat = nodes.values
            node, root, n, block = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "n_words", "block"))
            order = np.lexsort((node, n))
            node, root, n, block = node[order], root[order], n[order], block[order]
            flat = flat.take(pa.array(order))
            all_, few = _counted(flat.field("cells").to_pylist())
            numbers, has = _own_numbers(flat)
            # In order of words: similar texts are up to a quarter longer.
            ends = np.searchsorted(n, n / THRESHOLD + 1e-9, "right")
            left, right = [], []
            for x in range(len(node)):
                at = np.arange(x + 1, ends[x])
                at = at[(root[at] != root[x]) & ((i == j) | (block[at] != block[x]))]
                for counts in (few, all_):
                    if len(at):
                        at = at[_differ(counts[x], counts[at]) <= n[at] * (1 - THRESHOLD) + 1e-9]
                if len(at):
                    equal = (numbers[at] == numbers[x]) & has[at] & has[x]
                    first = equal.argmax(axis=1)
                    at = at[~equal.any(axis=1) | (numbers[at, first] == value)]
                left.append(np.full(len(at), node[x]))
                right.append(node[at])
            x, y = np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _alike_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose word counts allow the threshold: each changed word moves one from a cell to another."""
    for batch in batches:
        x, y = (_counted(batch.column(c).to_pylist())[0] for c in ("cells_a", "cells_b"))
        most = np.maximum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) * (1 - THRESHOLD) + 1e-9
        yield batch.select(["a", "b"]).filter(pa.array(_differ(x, y) <= most))


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            a, b = part.column("text_a").to_pylist(), part.column("text_b").to_pylist()
            for x, y in zip(a, b, strict=True):
                flat, sizes = normal_words([x or "", y or ""])
                flat = flat.tolist()
                keep.append(similar(flat[: sizes[0]], flat[sizes[0] :]))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "same"])


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) without those whose word counts rule the threshold out."""
    left = nodes.select(F.col("node").alias("a"), F.col("cells").alias("cells_a"), F.col("n_words").alias("n_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("cells").alias("cells_b"), F.col("n_words").alias("n_b"))
    both = pairs.select("a", "b").join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return settled(both.mapInArrow(_alike_batches, "a long, b long"), "near-alike")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, same) of pairs of node numbers."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return settled(pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b").mapInArrow(_verify_batches, "a long, b long, same boolean"), "near-verified")


def _apart(pairs: DataFrame, roots: DataFrame, ends: bool = False) -> DataFrame:
    """Rows of ``pairs`` (a, b, ...) whose nodes have different roots; with ``ends`` the pairs of roots."""
    known = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left")
    known = known.withColumns({"root_a": F.coalesce("root_a", "a"), "root_b": F.coalesce("root_b", "b")}).filter("root_a <> root_b")
    return settled(known.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "near-ends") if ends else known.select(*pairs.columns)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over ``links`` (a, b) from each linked node.

    Every round each node takes the least root among itself and its neighbours, then
    the root of that root, until nothing changes; rounds grow with the logarithm of
    the longest chain.
    """
    both = settled(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-links")
    roots = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "near-roots")
    while True:
        told = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("said"))
        nearer = roots.join(told, "node").select("node", F.least("root", "said").alias("near"), F.col("root").alias("was"))
        jumped = nearer.join(roots.select(F.col("node").alias("near"), F.col("root").alias("far")), "near", "left")
        after = settled(jumped.select("node", F.least("near", F.coalesce("far", "near")).alias("root"), "was"), "near-roots")
        roots = after.select("node", "root")
        if after.filter("root <> was").isEmpty():
            return roots


def rooted(links: DataFrame) -> DataFrame:
    """(node, root) of nodes b from ``links`` (a, b) in which each b has one a, a lesser one: pointers jump until they are at a root."""
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    while True:
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        jumped = settled(roots.join(above, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "near-roots")
        roots = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return roots


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more ``links`` (a, b): only their ends' roots are joined into components."""
    if links.isEmpty():
        return roots
    ends = _apart(links, roots, ends=True)
    if ends.isEmpty():
        return roots
    tops = components(ends).filter("node <> root")
    moved = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return settled(moved.unionByName(tops), "near-roots")


def _joined(pairs: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """``roots`` after the links that ``pairs`` (a, b) make: one pair a node is aligned first, of
    the others those that don't connect already."""
    tried = _verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts)
    roots = merged(roots, tried.filter("same").select("a", "b"))
    others = settled(_apart(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), roots), "near-others")
    return roots if others.isEmpty() else merged(roots, _verified(others, texts).filter("same").select("a", "b"))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (value, node, ...) of the buckets that hold several roots, with their root and ``top``, that of the first."""
    known = members.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("root", "node").alias("top")).filter("low <> high")
    return settled(known.join(mixed.select("value", "top").hint("merge"), "value").select(*members.columns, "root", "top"), "near-open")


def _in_blocks(open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes of a bucket with different roots that may be similar, from ``open_`` (value, node,
    n_words, sketch, root): large buckets are cut into blocks, each two of which are one task's work.

    A node brings its numbers of these buckets only: nodes with different roots have no others in common."""
    sizes = open_.groupBy("value").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    sizes = sizes.select("value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    keys = open_.filter(F.col("sketch") < SKETCHES + FEW_SKETCHES).groupBy("node").agg(F.collect_list(F.struct("value", F.col("sketch").cast("byte").alias("sketch"))).alias("x"))
    keys = keys.select("node", F.col("x")["value"].alias("numbers"), F.col("x")["sketch"].alias("sketches"))
    placed = open_.join(sizes.hint("merge"), "value").join(nodes.select("node", "cells").hint("merge"), "node").join(keys.hint("merge"), "node", "left")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.struct("node", "root", "n_words", "block", "cells", "numbers", "sketches").alias("own"))
    groups = dealt.groupBy("value", "i", "j").agg(F.collect_list("own").alias("nodes"))
    return settled(groups.mapInArrow(_block_batches, "a long, b long").distinct(), "near-rest")


def classes(docs: DataFrame) -> DataFrame:
    """Near-duplicate class of each row of ``docs`` (doc_id, text): doc_id, digest (of the text), class_id, keep.

    Joins of tables that grow with the corpus are sort-merge joins at every size, so
    plans and shuffles are alike at every size and hot buckets can be split.

    Equal texts are one node from the start, so copies are never paired. Every node is first
    tried with the first node of one of its buckets (nodes with an equal key), then, in buckets that
    still hold several classes, with the first node of each whose class isn't its own. Then all
    nodes of the buckets that hold several classes even now are compared, members of any class
    included, by their word counts, block by block, and what these allow is aligned: no pair is
    left unresolved. Links join into classes; class_id is the least doc_id of a class.

    ``keep`` is true for the row whose doc_id is the class_id (of rows with the same
    doc_id and text, all). A null text counts as an empty one; texts without any word
    are equal only if they are equal character by character. Null doc_id is allowed:
    it is no class_id unless all of a class are null. Other columns are not read; an
    empty table gives no rows.
    """
    schema = "doc_id long, digest string, n_words long, keys array<long>, cells binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    nodes = rows.mapInArrow(_sketch_batches, schema).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n_words", "keys", "cells")))
    nodes = settled(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    # A key holds its place among the sketches, so it alone is a bucket.
    keyed = nodes.filter("n_words > 0").select("node", "n_words", F.posexplode("keys").alias("sketch", "value"))
    # Texts of under LEAST words have numbers of the second kind only; deletion keys come behind all.
    keyed = keyed.withColumn("sketch", F.col("sketch") + F.when(F.col("n_words") < LEAST, SKETCHES).otherwise(0))
    buckets = keyed.groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct("node", "n_words")).alias("f")).filter("n > 1")
    buckets = settled(buckets.select("value", F.col("f.node").alias("first"), F.col("f.n_words").alias("n_first")), "near-buckets")
    members = settled(keyed.join(buckets.hint("merge"), "value"), "near-members")

    wanted = settled(members.select("node").distinct().join(nodes.select("node", "digest", "doc_id").hint("merge"), "node"), "near-wanted")
    found = rows.join(wanted.withColumnRenamed("doc_id", "of").hint("merge"), "digest").filter(F.col("doc_id").eqNullSafe(F.col("of")))
    texts = settled(found.groupBy("node").agg(F.first("text").alias("text")), "near-texts")

    near = F.least("n_first", "n_words") >= F.greatest("n_first", "n_words") * F.lit(THRESHOLD) - F.lit(1e-9)
    one = members.filter(F.col("node") != F.col("first")).filter(near).groupBy(F.col("node").alias("b")).agg(F.min("first").alias("a"))
    tried = _verified(_alike(one, nodes), texts)
    roots = rooted(tried.filter("same").select("a", "b"))
    open_ = _mixed(members, roots)
    others = open_.filter(F.col("root") != F.col("top")).filter(near).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    others = _alike(others.join(tried.select("a", "b"), ["a", "b"], "left_anti"), nodes)
    if not others.isEmpty():
        roots = _joined(others, roots, texts)
        open_ = _mixed(open_.select(*members.columns), roots)
    rest = _in_blocks(open_, nodes)
    if not rest.isEmpty():
        roots = _joined(rest, roots, texts)
    owners = nodes.select("node", "digest", "doc_id")
    owners = owners.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    owners = settled(owners, "near-owners")
    named = owners.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min_by("digest", F.struct("doc_id", "digest")).alias("kept"))
    named = settled(owners.join(settled(named, "near-classes"), "root").select("digest", "class_id", "kept"), "near-named")
    result = rows.select("doc_id", "digest").join(named, "digest")
    return result.select("doc_id", "digest", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("kept"))).alias("keep"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the least doc_id
    (of equal rows, one). All columns pass through."""
    key, row, of, digest = fresh(docs.columns, "key", "row", "of", "digest")
    kept = classes(docs.select("doc_id", "text")).filter("keep").select(F.col("doc_id").alias(of), F.col("digest").alias(digest)).distinct()
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    found = keyed.join(kept, (F.col(key) == F.col(digest)) & F.col("doc_id").eqNullSafe(F.col(of)), "left_semi")
    order = Window.partitionBy(key, "doc_id").orderBy(key)
    return found.withColumn(row, F.row_number().over(order)).filter(F.col(row) == 1).select(*docs.columns)
