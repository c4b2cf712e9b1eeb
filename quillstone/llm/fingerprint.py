"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line with anything but white space) is hashed to a wide vector;
the fingerprint is the sum of the vectors, each lane modulo a power of two. So it
doesn't depend on the order of paragraphs, and inserting or deleting a paragraph
is adding or subtracting its vector.

Lanes: four of 60 bits from SHA-256 of the paragraph (equality), the number of
its sentences modulo 2**30, and 120 smaller ones modulo 2**30 that count, over its
sentences, the one-bits of two 60-bit hashes, two to a number. The smaller lanes,
taken as +1 and -1 for each sentence, make the cosine of two fingerprints an estimate
of the cosine of their sentence multisets, up to 2**30 sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

EXACT, COUNT_BITS, HASHES, SHIFTS = 4, 30, 2, 15
#: Bits 0, 15, 30 and 45: one bit for each of four narrow lanes of a number. Sentences are
#: counted in narrow lanes, as many at once as these hold, and then added to the wide ones.
ONES = sum(1 << (15 * i) for i in range(4))
AT_ONCE = 2**14 - 1
#: The two wide lanes of a number, at bits 0 and 31, and their carry bits.
WIDE = (2**30 - 1) * (1 + 2**31)
CARRY = 2**30 * (1 + 2**31)
NUMBERS = 2 * HASHES * SHIFTS


def paragraphs(text: Column) -> Column:
    """Lines of a text that have more than white space; none for null."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda x: F.trim(x) != "")


def sentences(paragraph: Column) -> Column:
    """Pieces of a paragraph after each of ``.!?`` and white space."""
    return F.filter(F.split(paragraph, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as array<bigint> column ``name``: 4
    equality lanes, the count, 60 packed numbers. Null and empty texts have the zero vector.

    Lines, digests, sentences and hashes are columns of their own steps, so none is computed twice.
    """
    lines, digests, pieces, *hashes = fresh([*df.columns, name], "lines", "digests", "pieces", *(f"hash{h}" for h in range(HASHES)))
    step = df.withColumn(lines, paragraphs(F.col(text)))
    step = step.withColumns({digests: F.transform(lines, lambda x: F.sha2(x, 256)), pieces: F.flatten(F.transform(lines, sentences))}).drop(lines)

    def hashed(h: int) -> Column:
        return F.transform(pieces, lambda x: F.xxhash64(x, F.lit(h)))

    step = step.withColumns({column: hashed(h) for h, column in enumerate(hashes)}).drop(pieces)

    def exact(i: int) -> Column:
        return F.aggregate(digests, F.lit(0).cast("long"), lambda acc, d: (acc + F.conv(F.substring(d, 1 + 15 * i, 15), 16, 10).cast("long")).bitwiseAND(F.lit(2**60 - 1)))

    def narrow(some: Column) -> Column:
        # One step a sentence: each packed number gets one bit for each of its four lanes.
        zero = F.array(*[F.lit(0).cast("long")] * SHIFTS)
        return F.aggregate(some, zero, lambda acc, x: F.array(*(acc[k] + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(ONES)) for k in range(SHIFTS))))

    def lane(x: Column, i: int) -> Column:
        return F.shiftrightunsigned(x, 15 * i).bitwiseAND(F.lit(AT_ONCE))

    def widened(numbers: Column) -> Column:
        return F.flatten(F.transform(numbers, lambda x: F.array(*(lane(x, i) + F.shiftleft(lane(x, i + 1), 31) for i in (0, 2)))))

    def packed(column: str) -> Column:
        one = widened(narrow(F.col(column)))
        # Longer texts go part by part; lanes of 30 bits wrap as they are defined to.
        starts = F.sequence(F.lit(1), F.greatest(F.size(column), F.lit(1)), F.lit(AT_ONCE))
        zero = F.array_repeat(F.lit(0).cast("long"), 2 * SHIFTS)
        parts = F.aggregate(starts, zero, lambda acc, i: F.zip_with(acc, widened(narrow(F.slice(column, i, AT_ONCE))), lambda x, y: (x + y).bitwiseAND(F.lit(WIDE))))
        return F.when(F.size(column) <= AT_ONCE, one).otherwise(parts)

    count = F.size(hashes[0]).cast("long").bitwiseAND(F.lit(2**COUNT_BITS - 1))
    lanes = F.concat(F.array(*(exact(i) for i in range(EXACT)), count), *(packed(column) for column in hashes))
    return step.withColumn(name, lanes).drop(digests, *hashes)


def _mask(i: Column) -> Column:
    return F.when(i < EXACT, F.lit(2**60 - 1)).when(i == EXACT, F.lit(2**COUNT_BITS - 1)).otherwise(F.lit(WIDE))


def inserted(one: Column, other: Column) -> Column:
    """Fingerprint of a text's paragraphs with those of another: lane-wise sum."""
    at = F.sequence(F.lit(0), F.lit(EXACT + NUMBERS))
    return F.transform(at, lambda i: (one[i] + other[i]).bitwiseAND(_mask(i)))


def deleted(one: Column, other: Column) -> Column:
    """Fingerprint of what is left of ``one`` without the paragraphs of ``other``."""
    at = F.sequence(F.lit(0), F.lit(EXACT + NUMBERS))
    return F.transform(at, lambda i: F.when(i <= EXACT, (one[i] - other[i]).bitwiseAND(_mask(i))).otherwise((one[i].bitwiseOR(F.lit(CARRY)) - other[i]).bitwiseAND(_mask(i))))


def as_hex(lanes: Column) -> Column:
    """A fingerprint as a hexadecimal string, 16 digits a number: equal fingerprints, equal strings."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _signed(lanes: Column) -> Column:
    """120 numbers: for each smaller lane, +1 and -1 of all sentences summed."""
    numbers = F.slice(lanes, EXACT + 2, NUMBERS)
    count = lanes[EXACT]
    return F.flatten(F.transform(numbers, lambda x: F.array(*((F.lit(2) * F.shiftrightunsigned(x, 31 * i).bitwiseAND(F.lit(2**30 - 1)) - count).cast("double") for i in range(2)))))


def likeness(one: Column, other: Column) -> Column:
    """0 to 1: estimated cosine of the sentence multisets; 1 if the fingerprints are
    equal (two empty ones too), 0 if just one is empty or the estimate is negative."""
    a, b = _signed(one), _signed(other)

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)

    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x)) * total(F.transform(b, lambda x: x * x)))
    return F.when(one == other, 1.0).when(norm == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norm)))


#: Parts into which a cell with too much text is cut (the first two into more, if there are more buckets), and how many buckets there are at most.
FAN, MOST_BUCKETS = 256, 100_000


def _part(key: Column, low: Column, exact: Column, width: Column, fan: int) -> Column:
    """Number of the equal part of a range in which ``key`` is."""
    # The difference of two bigints may be none.
    off = F.when(exact, F.try_subtract(key, low).cast("double")).otherwise(key.cast("double") - low.cast("double"))
    return F.least(F.lit(fan - 1), F.greatest(F.lit(0), F.floor(off / width))).cast("long")


def _cut(rows: DataFrame, cells: list[tuple], fan: int = FAN, only: bool = False) -> DataFrame:
    """``rows`` (cell, k1, k2, ...) with those of ``cells`` (cell, by, low, exact, width, base) moved to
    the cell ``base`` plus their place in order among ``fan`` equal parts of the range of key ``by``; the
    others stay, or with ``only`` go. The cells 0 and 1, in which all rows are at first, take no join."""
    if all(name < 2 for name, *_ in cells):
        moved = F.col("cell")
        for name, by, low, exact, width, base in cells:
            moved = F.when(F.col("cell") == name, F.lit(base).cast("long") + _part(F.col(f"k{by}"), F.lit(low).cast("long"), F.lit(exact), F.lit(width), fan)).otherwise(moved)
        return (rows.filter(F.col("cell").isin([c[0] for c in cells])) if only else rows).withColumn("cell", moved)
    wide = rows.sparkSession.createDataFrame(cells, "cut long, by int, low long, exact boolean, width double, base long")
    key = F.when(F.col("by") == 1, F.col("k1")).otherwise(F.col("k2"))
    moved = rows.join(F.broadcast(wide), F.col("cell") == F.col("cut"), "inner" if only else "left")
    part = _part(key, F.col("low"), F.col("exact"), F.col("width"), fan)
    return moved.withColumn("cell", F.when(F.col("cut").isNull(), F.col("cell")).otherwise(F.col("base") + part)).drop("cut", "by", "low", "exact", "width", "base")


def first_fan(buckets: int) -> int:
    """Parts of the first cut: so many that ids spread evenly need no other."""
    return max(FAN, 16 * buckets)


def cells(keys: DataFrame, buckets: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Cells of ``keys`` (cell, k1, k2, weight) of about an eighth of a bucket's weight at most: the cuts,
    level by level, and (cell, weight, first k1, first k2) in order.

    Cell 0 holds the rows with an id, cell 1 those without. A cell with too much is cut into equal ranges
    (``first_fan`` at first, then FAN) of k1 while these differ, else of k2; only rows of such cells are
    cut and counted again, so no more than so many numbers a heavy cell reach the driver. Rows with equal
    k1 and k2 can't be told apart.
    """
    cuts: list[list[tuple]] = []
    whole, order, next_name, found = None, [0, 1], 2, {}
    while True:
        stats = keys.groupBy("cell").agg(F.sum("weight").alias("weight"), F.min(F.struct("k1", "k2")).alias("first"), *(f(k).alias(f"{n}_{k}") for k in ("k1", "k2") for n, f in (("low", F.min), ("high", F.max))))
        fresh_cells = {r.cell: r for r in stats.collect()}
        found |= fresh_cells
        whole = whole or max(1, sum(r.weight for r in fresh_cells.values()))
        level, fan, names = [], FAN if cuts else first_fan(buckets), {}
        for name, r in sorted(fresh_cells.items()):
            by, low, high = (1, r.low_k1, r.high_k1) if r.low_k1 < r.high_k1 else (2, r.low_k2, r.high_k2)
            if r.weight > whole / (8 * buckets) and low < high:
                level.append((name, by, low, high - low < 2**62, (high - low + 1) / fan, next_name))
                names[name] = range(next_name, next_name + fan)
                next_name += fan
                del found[name]
        if not level:
            return cuts, [(c, found[c].weight, found[c]["first"].k1, found[c]["first"].k2) for c in order if c in found]
        order = [x for c in order if c in found or c in names for x in names.get(c, (c,))]
        cuts.append(level)
        keys = _cut(keys, level, fan, only=True)


def with_next(docs: DataFrame, buckets: int, *carried: str) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, ...) with next_<c> for each c of ``carried``: the
    value in the next row by descending doc_id (nulls last; equal ids by a hash of the text, then
    by the text), after the last the first.

    One shuffle of texts: rows are dealt into about ``buckets`` buckets that are neighbours in this
    order and hold about as much text each. Bounds come from ``cells``, which read only ids and sizes and
    refine where much text is, so neither an outlier nor many equal or null ids fill a bucket. The first
    rows of a bucket also go to the bucket before it, where they only serve as next of its last row.
    """
    spark, number = docs.sparkSession, F.col("doc_id").cast("long")
    buckets = max(1, min(buckets, MOST_BUCKETS))
    own = [c for c in docs.columns if c.lower() not in ("cell", "k1", "k2", "weight", "at", "spare", "bucket", "before")]
    docs = docs.select(own)
    # ~id ascends as the id descends.
    keyed = docs.withColumns({"cell": F.when(number.isNull(), 1).otherwise(0).cast("long"), "k1": F.coalesce(F.bitwise_not(number), F.lit(0)), "k2": F.xxhash64("text")})
    cuts, counted = cells(keyed.select("cell", "k1", "k2", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("weight")), buckets)
    for i, level in enumerate(cuts):
        keyed = _cut(keyed, level, FAN if i else first_fan(buckets))
    each = sum(c[1] for c in counted) / buckets
    plan, filled, bucket, starts = [], 0.0, -1, []
    for name, weight, k1, k2 in counted:
        if bucket < 0 or filled + weight / 2 > each:
            bucket, filled = bucket + 1, 0.0
            starts.append((k1, k2))
            plan.append((name, bucket, bucket - 1, k1, k2))
        else:
            plan.append((name, bucket, None, None, None))
        filled += weight
    plan = [(c, b, bucket if before == -1 else before, k1, k2) for c, b, before, k1, k2 in plan]
    where = spark.createDataFrame(plan, "at_cell long, bucket long, before long, least1 long, least2 long")
    dealt = keyed.join(F.broadcast(where), F.col("cell") == F.col("at_cell"))
    first = F.col("before").isNotNull() & (F.col("k1") == F.col("least1")) & (F.col("k2") == F.col("least2"))
    spare = F.when(first, F.struct(F.col("before").alias("at"), F.lit(True).alias("spare")))
    both = dealt.withColumn("to", F.explode(F.array_compact(F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("spare")), spare))))
    both = both.select(*own, "k2", "to.at", "to.spare")
    order = Window.partitionBy("at").orderBy("spare", F.desc_nulls_last("doc_id"), "k2", "text")
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).filter(~F.col("spare")).drop("at", "spare", "k2")


def with_edits(docs: DataFrame, buckets: int) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text) and of its edited text, in which
    the last half of the code points is replaced by as many first ones (or all) of the next document.

    Null text counts as empty. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. An empty table gives no rows; null and
    repeated doc_id are ordered as ``with_next`` says; other columns are not read.
    """
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = with_next(with_fingerprint(own, "text", "lanes"), buckets, "text", "lanes")
    n_chars = F.length("text").cast("long")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), F.col("n_chars").cast("int") - half), F.left(F.col("next_text"), half))
    rows = own.withColumn("n_chars", n_chars).withColumn("edited", edited)
    rows = with_fingerprint(rows.drop("next_text"), "edited", "edited_lanes")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_hex(F.col("lanes")).alias("fingerprint"), as_hex(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
