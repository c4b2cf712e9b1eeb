"""Line dedup by the suffix array of line-ID sequences, built by prefix doubling.

Every document is a sequence of line IDs (two 64-bit hashes of a line). Round k
ranks the runs of 2**k lines that occur at least twice: pairs of ranks of round
k - 1 are sorted and named in order, so a rank is the place of a run in the order
of suffixes by their first 2**k lines. A suffix whose rank is alone has no longer
common prefix and drops out; rounds end when none is left. The rounds that a
suffix stays in give its longest common prefix with others, and the first
occurrence in its rank tells whether it is a later copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, settled

DOC = ["doc_key", "text_key"]


def _keys() -> tuple[Column, Column]:
    """Order and identity of documents: doc_id (null last), then a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.xxhash64("text")


def line_ids(docs: DataFrame, alone: int | None = None) -> DataFrame:
    """doc_key, text_key, idx (among all lines), seq (among lines with more than spaces), h1, h2,
    long (whether the line has ``alone`` characters)."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("idx"), x.alias("line"))), lambda x: F.trim(x["line"]) != "")
    rows = docs.select("doc_id", "text").withColumns(dict(zip(DOC, _keys(), strict=True))).filter("text is not null")
    rows = rows.select(*DOC, F.posexplode(F.transform(lines, lambda x: F.struct(x["idx"].alias("idx"), F.xxhash64(x["line"]).alias("h1"), F.xxhash64(x["line"], F.lit(7)).alias("h2"), (F.length(x["line"]) >= alone if alone is not None else F.lit(False)).alias("long")))).alias("seq", "x"))
    return rows.select(*DOC, "x.idx", "seq", "x.h1", "x.h2", "x.long")


def ranked(positions: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``positions`` whose ``keys`` occur at least twice, with ``rank`` (ascending with
    the keys) and ``later`` (not the first of its rank in document order).

    Keys are counted first, so a very common one is a single row when they are sorted.
    """
    place = F.struct(*DOC, "seq")
    classes = positions.groupBy(*keys).agg(F.count("*").alias("copies"), F.min(place).alias("first")).filter("copies > 1")
    classes = settled(classes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()).drop("copies"), f"{name}-classes")
    return settled(positions.join(classes, keys).select(*DOC, "idx", "seq", "long", "rank", (place > F.col("first")).alias("later")), name)


def later_copies(docs: DataFrame, min_lines: int = 2, alone: int | None = None) -> DataFrame:
    """Lines to delete: doc_key, text_key, idx of every line inside a run of at least
    ``min_lines`` lines, or a single line of ``alone`` characters at least, that also begins
    at an earlier place (by doc_id, then line).

    Rounds go by 1, 2, 4, ... lines to ``min_lines`` and double from there. A maximal
    repeated run of m lines is covered by two runs of the longest such length up to
    m, so from each suffix the longest interval that is a later copy is enough: these
    cover all lines of maximal runs and no others.
    """
    base = settled(line_ids(docs, alone).dropDuplicates([*DOC, "seq"]), "line-ids")
    rank = ranked(base, ["h1", "h2"], "line-rank")
    length, covers = 1, None
    doc = Window.partitionBy(*DOC).orderBy("seq")
    while not rank.isEmpty():
        if length >= min_lines or length == 1:
            found = rank.filter("later" if length >= min_lines else "later and long").select(*DOC, "seq", F.lit(length).alias("lines"))
            covers = found if covers is None else covers.unionByName(found)
        longer = min_lines if length < min_lines < 2 * length else 2 * length
        step = longer - length
        pairs = rank.withColumn("rank2", F.first("rank").over(doc.rangeBetween(step, step))).filter("rank2 is not null")
        rank = ranked(pairs.withColumnRenamed("rank", "rank1"), ["rank1", "rank2"], "line-rank")
        length = longer
    if covers is None:
        return base.select(*DOC, "idx").limit(0)
    longest = covers.groupBy(*DOC, "seq").agg(F.max("lines").alias("lines"))
    # A line is deleted if an interval that begins at or before it ends behind it.
    ends = base.select(*DOC, "idx", "seq").join(longest, [*DOC, "seq"], "left")
    reach = F.max(F.col("seq") + F.col("lines")).over(doc.rowsBetween(Window.unboundedPreceding, 0))
    return ends.withColumn("reach", reach).filter("reach > seq").select(*DOC, "idx")


def dedup_lines(docs: DataFrame, min_lines: int = 2, alone: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) without later copies of repeated runs of at least
    ``min_lines`` lines; two more columns: n_lines (before) and n_removed.

    A run of fewer lines counts too if it is a single line of ``alone`` characters at least.
    Lines are compared exactly. Lines of spaces only are no part of runs and stay;
    a null text has 0 lines and stays null, an empty one has one line and stays.
    Documents come in order of doc_id, null last, equal ones by a hash of the text;
    rows equal in doc_id and text count as one document and are treated alike. A
    text all of whose lines go becomes empty. An empty table gives no rows. Other
    columns pass through; ones named n_lines or n_removed are replaced.
    """
    gone, kept, doc_key, text_key = fresh(docs.columns, "gone", "kept", *DOC)
    found = later_copies(docs.select("doc_id", "text"), min_lines, alone).groupBy(*DOC).agg(F.collect_set("idx").alias(gone)).withColumnsRenamed({DOC[0]: doc_key, DOC[1]: text_key})
    keys = dict(zip((doc_key, text_key), _keys(), strict=True))
    rows = docs.drop("n_lines", "n_removed").withColumns(keys).join(found, [doc_key, text_key], "left")
    lines = F.split("text", "\n")
    last = F.size(lines) - 1
    left = F.transform(F.array_except(F.sequence(F.lit(0), last), F.col(gone)), lambda i: F.get(lines, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.coalesce(F.size(gone), F.lit(0)).cast("long")
    rows = rows.withColumns({"n_lines": n_lines, "n_removed": n_removed, kept: text})
    return rows.select(*(F.col(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")
