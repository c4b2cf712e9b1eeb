"""Registered queries of the subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprint, langid, licenses, linededup, mixing, neardup, ngramlm, passages, urlfilter
from .common import blocks_for, shuffle_partitions, table


#: Characters from which a single repeated line counts as a passage.
LINE_ALONE = 20


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.filter(~out))
    return langid.identify(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or reworded."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontam.with_hits(docs, items).filter(F.size("hits") > 0)
    return found.select("doc_id", F.inline("hits"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix at 150 % of all words takes from each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that documents name or grant."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside passages that an earlier document has."""
    found = passages.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    found = neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "keep")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document under counts of all documents."""
    return ngramlm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of pages."""
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint.with_edits(docs, max(shuffle_partitions(spark), blocks_for(spark, docs, 4.0)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated runs of lines: two lines, or one of 20 characters."""
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), alone=LINE_ALONE)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: Runs of two lines and single long ones decide: a longer run that begins earlier too is made of such.
OP10_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents),
s AS (SELECT doc_id, idx, line, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS seq FROM l WHERE trim(line) <> ''),
w AS (SELECT doc_id, seq, line, lead(line) OVER (PARTITION BY doc_id ORDER BY seq) AS next_line FROM s),
f AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, seq) AS nth FROM w WHERE next_line IS NOT NULL),
o AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) AS nth FROM s WHERE length(line) >= 20),
d AS (SELECT doc_id, seq FROM f WHERE nth > 1 UNION SELECT doc_id, seq + 1 FROM f WHERE nth > 1 UNION SELECT doc_id, seq FROM o WHERE nth > 1),
g AS (SELECT s.doc_id, s.idx FROM s JOIN d USING (doc_id, seq)),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.idx) AS n_removed,
             coalesce(string_agg(l.line, chr(10) ORDER BY l.idx) FILTER (WHERE g.idx IS NULL), '') AS kept
      FROM l LEFT JOIN g USING (doc_id, idx) GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k
"""


#: A run of 50 words that also starts in a smaller doc_id; words from a removed run's start to its end go.
OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
r AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER s AS run, count(*) OVER s AS n FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
k AS (SELECT doc_id, i, word, CASE WHEN n = 50 THEN md5(run) END AS run FROM r),
o AS (SELECT run, min(doc_id) AS owner FROM k WHERE run IS NOT NULL GROUP BY run),
h AS (SELECT k.doc_id, i, word, CASE WHEN o.owner < k.doc_id THEN i END AS hit FROM k LEFT JOIN o USING (run)),
g AS (SELECT doc_id, i, word, coalesce(max(hit) OVER (PARTITION BY doc_id ORDER BY i), -99) > i - 50 AS gone FROM h),
d AS (SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN d USING (doc_id)
"""


def mix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix counts: words of each document and of its source."""
    return op3_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size")


MIX_SIZES_SQL = r"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents)
SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM t
"""


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the filter reads in each url, and the rule that fits."""
    return op8_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


URL_RULES_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
k(rh, rp) AS (VALUES {", ".join(f"('{h}', '{p}')" for _, h, p in urlfilter.RULES)})
SELECT page_id, host, path, (SELECT arg_max(rh || rp, length(rh || rp)) FROM k WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule FROM p
"""


def text_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of texts and digests of the edited ones that are fingerprinted."""
    return op9_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


TEXT_EDITS_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM t)
SELECT doc_id, n AS n_chars, sha256(substr(text, 1, n - n // 2) || substr(following, 1, n // 2)) AS edited_sha256 FROM n
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_decontaminate": op2_decontaminate,
        "op3_mix_sources": op3_mix_sources,
        "op4_license_scan": op4_license_scan,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_lm_scores": op7_lm_scores,
        "op8_url_filter": op8_url_filter,
        "op9_fingerprints": op9_fingerprints,
        "op10_line_dedup": op10_line_dedup,
        "mix_sizes": mix_sizes,
        "url_rules": url_rules,
        "text_edits": text_edits,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": OP5_SQL, "op10_line_dedup": OP10_SQL, "mix_sizes": MIX_SIZES_SQL, "url_rules": URL_RULES_SQL, "text_edits": TEXT_EDITS_SQL}
