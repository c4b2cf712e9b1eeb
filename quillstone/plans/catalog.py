"""Registered queries of the document engine and the SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, fields, identifiers, numerals
from ..functions import text as tx
from ..operators import arbitrate, evaluate, gates, intervals, layout, lines, process, render
from ..sources import files, sinks
from ..streaming import jobs
from ..schemas import FIELD_KEYS
from . import inputs
from .inputs import WORDS_SQL, duck, shared, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- gates -----------------------------------------------------------------

LATIN = "[A-Za-z]"
GATE_SQL = """b AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents),
g AS (SELECT doc_id, body, length(body) AS n, length(regexp_replace(body, '[^\\pL]', '', 'g')) / greatest(length(body), 1) AS alpha,
  list_filter(string_split_regex(body, '\\s+'), lambda w: w <> '') AS w FROM b),
r AS (SELECT doc_id, alpha AS alpha_ratio, CASE WHEN n < 40 THEN 'empty' WHEN NOT regexp_matches(body, '[A-Za-z]') THEN 'script' WHEN alpha < 0.45 THEN 'few_letters'
  WHEN len(list_filter(w, lambda x: length(x) = 1)) / greatest(len(w), 1) > 0.35 THEN 'single_characters' ELSE 'ok' END AS reason FROM g)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", gates.text_layer_gate(F.col("text"), script=LATIN).alias("g")).select("doc_id", "g.*")


@query(f"WITH {GATE_SQL} SELECT reason, count(*) AS docs, round(avg(alpha_ratio), 6) AS alpha_ratio FROM r GROUP BY reason")
def text_gate(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("docs"), F.round(F.avg("alpha_ratio"), 6).alias("alpha_ratio"))


@query(f"WITH {GATE_SQL} SELECT doc_id, reason = 'ok' AS usable, reason, round(alpha_ratio, 6) AS alpha_ratio FROM r")
def text_gate_rows(spark, sf_dir):
    return _gated(spark, sf_dir).withColumn("alpha_ratio", F.round("alpha_ratio", 6))


# --- identifiers -----------------------------------------------------------


def _weights(s: str, weights) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr({s}, {i}, 1) AS INT)" for i, w in enumerate(weights, 1)) + ") % 11"


def _control(s: str) -> str:
    a, b = _weights(s, range(1, 12)), _weights(s, identifiers.SECOND_WEIGHTS)
    return f"(CASE WHEN {a} < 10 THEN {a} WHEN {b} < 10 THEN {b} END)"


def _valid(s: str) -> str:
    return f"coalesce({_control(f'substr({s}, 1, 11)')} = CAST(substr({s}, 12, 1) AS INT), false)"


def _structure(s: str) -> tuple[str, str]:
    company = f"regexp_matches({s}, '^[0-9]{{2}}(0[1-9]|1[0-2])[456][0123][0-9]{{6}}$')"
    born = f"CAST(1800 + CAST(floor((CAST(substr({s}, 7, 1) AS INT) - 1) / 2) AS INT) * 100 + CAST(substr({s}, 1, 2) AS INT) AS VARCHAR) || '-' || substr({s}, 3, 2) || '-' || substr({s}, 5, 2)"
    return company, f"(substr({s}, 7, 1) IN ('1', '2', '3', '4', '5', '6') AND try_cast({born} AS DATE) IS NOT NULL)"


@query(f"SELECT o_orderkey, s, {_control('s')} AS control, coalesce({_control('s')} = 5, false) AS valid FROM ({duck(inputs.ELEVEN)})")
def id_checksum(spark, sf_dir):
    rows = shared(spark, sf_dir, inputs.ELEVEN)
    return rows.select("o_orderkey", "s", identifiers.control_digit(F.col("s")).alias("control"), identifiers.is_valid(F.concat("s", F.lit("5"))).alias("valid"))


@query(f"SELECT o_orderkey, s, {_structure('s')[0]} AS bin, {_structure('s')[1]} AS iin FROM ({duck(inputs.TWELVE)})")
def id_structural(spark, sf_dir):
    return shared(spark, sf_dir, inputs.TWELVE).select("o_orderkey", "s", identifiers.looks_like_bin(F.col("s")).alias("bin"), identifiers.looks_like_iin(F.col("s")).alias("iin"))


def _repaired(numbers: str) -> str:
    """CTEs up to f(o_orderkey, s, ok, cands) of the numbers that SQL gives."""
    return f"""t AS ({numbers}), c(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, bs in identifiers.CONFUSIONS.items() for b in bs)}),
n AS (SELECT o_orderkey, s, pos, substr(s, 1, pos - 1) || c.b || substr(s, pos + 1) AS v FROM t, range(1, 13) AS r(pos) JOIN c ON c.a = substr(s, pos, 1) WHERE NOT {_valid("s")}),
k AS (SELECT *, {_structure("v")[0]} OR {_structure("v")[1]} AS st FROM n WHERE {_valid("v")}),
g AS (SELECT o_orderkey, count(*) AS n, count_if(st) AS m, list(v ORDER BY pos, v) AS allc, coalesce(list(v ORDER BY pos, v) FILTER (WHERE st), []) AS stc FROM k GROUP BY o_orderkey),
f AS (SELECT t.o_orderkey, s, {_valid("s")} AS ok, CASE WHEN n > 1 AND m > 0 THEN stc ELSE coalesce(allc, []) END AS cands FROM t LEFT JOIN g USING (o_orderkey))"""


REPAIR_SQL = f"""WITH {_repaired(duck(inputs.TWELVE))}
SELECT o_orderkey, s, CASE WHEN ok THEN 'valid' WHEN len(cands) = 1 THEN 'fixed' WHEN len(cands) > 1 THEN 'ambiguous' ELSE 'invalid' END AS status,
  CASE WHEN NOT ok AND len(cands) = 1 THEN cands[1] ELSE s END AS value, CASE WHEN ok THEN s ELSE array_to_string(cands, ',') END AS candidates FROM f"""


@query(REPAIR_SQL)
def id_repair(spark, sf_dir):
    rows = identifiers.with_repair(shared(spark, sf_dir, inputs.TWELVE), "s", "r")
    return rows.select("o_orderkey", "s", "r.status", "r.value", F.array_join("r.candidates", ",").alias("candidates"))


SPLIT_IDS = f"""SELECT o_orderkey, s, CASE o_orderkey % 4 WHEN 0 THEN 'БИН ' || substr(s, 1, 4) || ' ' || substr(s, 5, 4) || ' ' || substr(s, 9, 4) || '.'
  WHEN 1 THEN '№ 15 ' || s WHEN 2 THEN substr(s, 1, 6) || '  ' || substr(s, 7, 6) ELSE s || ';' || s END AS text FROM ({inputs.TWELVE})"""


@query(f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN s WHEN 3 THEN s || ',' || s ELSE '' END AS found FROM ({duck(inputs.TWELVE)})")
def id_candidates(spark, sf_dir):
    return shared(spark, sf_dir, SPLIT_IDS).select("o_orderkey", F.array_join(identifiers.candidates(F.col("text")), ",").alias("found"))


# --- dates -----------------------------------------------------------------

ISO = "strftime(make_date(y, m, d), '%Y-%m-%d')"


def _dates(rows: DataFrame, found) -> DataFrame:
    return rows.select("o_orderkey", F.explode(found(F.col("text"))).alias("x")).select("o_orderkey", "x.value", "x.status")


@query(f"SELECT o_orderkey, CASE WHEN d < 29 OR m <> 2 THEN {ISO.replace('make_date(y, m, d)', 'make_date(y, m, CASE WHEN m = 2 AND d > 28 THEN 28 ELSE d END)')} ELSE CASE WHEN d = 29 THEN strftime(try_cast(y || '-02-29' AS DATE), '%Y-%m-%d') END END AS value, CASE WHEN m = 2 AND d > 29 THEN 'invalid' ELSE 'valid' END AS status FROM ({duck(inputs.DATED)})")
def dates_numeric(spark, sf_dir):
    return _dates(shared(spark, sf_dir, inputs.DATED), dates.numeric_dates)


@query(f"SELECT o_orderkey, CASE WHEN m = 2 AND d > 29 THEN NULL ELSE strftime(try_cast(y || '-' || m || '-' || d AS DATE), '%Y-%m-%d') END AS value, CASE WHEN m = 2 AND d > 29 THEN 'invalid' ELSE 'valid' END AS status FROM ({duck(inputs.DATED)}) WHERE o_orderkey % 5 <> 0")
def dates_textual(spark, sf_dir):
    return _dates(shared(spark, sf_dir, inputs.DATED_IN_WORDS), dates.textual_dates)


# --- amounts ---------------------------------------------------------------


@query(f"SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 < 4 THEN n END AS BIGINT) AS amount, o_orderkey % 5 IN (1, 2, 3) AS money FROM ({duck(inputs.DIGITS)})")
def amount_parse(spark, sf_dir):
    rows = shared(spark, sf_dir, inputs.DIGITS)
    return rows.select("o_orderkey", numerals.parse_digits(F.col("text")).cast("bigint").alias("amount"), numerals.money_form(F.col("text")).alias("money"))


@query(f"SELECT o_orderkey, CAST(value AS BIGINT) AS ru, CAST(value AS BIGINT) AS kk FROM ({duck(inputs.NUMERALS)})")
def amount_words(spark, sf_dir):
    rows = shared(spark, sf_dir, inputs.NUMERALS)
    return rows.select("o_orderkey", numerals.words_to_number(F.col("ru"), "ru").alias("ru"), numerals.words_to_number(F.col("kk"), "kk").alias("kk"))


# --- fields ----------------------------------------------------------------

SENT = duck(inputs.SENTENCES)


def _sentence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.field_hits(shared(spark, sf_dir, inputs.SENTENCES), "o_orderkey")


@query(
    f"""WITH t AS ({SENT}) SELECT o_orderkey, CAST(CASE WHEN wrong THEN value + 1 ELSE value END AS VARCHAR) AS amount, NOT wrong AS words_match,
  CASE WHEN NOT bad_date THEN strftime(strptime(raw_date, '%d.%m.%Y'), '%Y-%m-%d') END AS date, s12 AS bin_raw, {_valid("s12")} AS bin_valid FROM t"""
)
def fields_struct(spark, sf_dir):
    rows = fields.with_fields(shared(spark, sf_dir, inputs.SENTENCES), "text", "f").filter(F.size("f.amounts") > 0)
    amount, day, number = (F.get(f"f.{k}", F.lit(0)) for k in ("amounts", "dates", "bin"))
    return rows.select("o_orderkey", amount["value"].alias("amount"), amount["words_match"].alias("words_match"), day["value"].alias("date"), number["raw"].alias("bin_raw"), (number["status"] == "valid").alias("bin_valid"))


#: The warnings of each sentence in order: identifier, amount, date.
PROBLEMS_SQL = f"""WITH q AS ({SENT}), {_repaired("SELECT o_orderkey, s12 AS s FROM q")}, p AS (SELECT o_orderkey, 0 AS kind,
    CASE WHEN len(cands) = 0 THEN 'bin_checksum_failed' WHEN len(cands) = 1 THEN 'bin_repaired' ELSE 'bin_ambiguous_fix' END AS type,
    CASE WHEN len(cands) = 0 THEN s || ': контрольный разряд не сходится, кандидатов нет' WHEN len(cands) = 1 THEN s || ' → ' || cands[1] || ': исправлено по контрольной сумме, проверьте оригинал'
      ELSE s || ': несколько кандидатов [' || chr(39) || array_to_string(cands, chr(39) || ', ' || chr(39)) || chr(39) || '], не исправляем' END AS detail FROM f WHERE NOT ok
  UNION ALL SELECT o_orderkey, 1, 'amount_mismatch', (value + 1) || ' (' || ru || '): цифрами ' || (value + 1) || ', прописью ' || value FROM q WHERE wrong
  UNION ALL SELECT o_orderkey, 2, 'date_invalid', raw_date || ': несуществующая дата' FROM q WHERE bad_date)"""


@query(f"{PROBLEMS_SQL} SELECT o_orderkey, type FROM p")
def text_warnings(spark, sf_dir):
    return shared(spark, sf_dir, inputs.SENTENCES).select("o_orderkey", F.explode(fields.validate_text("text")).alias("w")).select("o_orderkey", "w.type")


@query(f"{PROBLEMS_SQL} SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY kind) - 1 AS INT) AS seq, type, detail FROM p")
def warnings_full(spark, sf_dir):
    rows = shared(spark, sf_dir, inputs.SENTENCES).select("o_orderkey", F.posexplode(fields.validate_text("text")).alias("seq", "w"))
    return rows.select("o_orderkey", "seq", "w.type", "w.detail")


@query(f"WITH q AS ({SENT}), {_repaired('SELECT o_orderkey, s12 AS s FROM q')} SELECT field, count(*) AS n FROM (SELECT 'dates' AS field FROM q WHERE NOT bad_date UNION ALL SELECT 'amounts' FROM q UNION ALL SELECT 'bin' FROM f WHERE ok OR len(cands) = 1) GROUP BY field")
def confirmed_values(spark, sf_dir):
    rows = fields.with_fields(shared(spark, sf_dir, inputs.SENTENCES), "text", "f").select(F.explode(fields.confirmed_values(F.col("f"))).alias("field", "v"))
    return rows.select("field", F.explode("v")).groupBy("field").agg(F.count("*").alias("n"))


@query(f"WITH t AS ({SENT}) SELECT o_orderkey, 'dates' AS field, raw_date AS raw FROM t WHERE bad_date UNION ALL SELECT o_orderkey, 'bin', s12 FROM t WHERE NOT {_valid('s12')} UNION ALL SELECT o_orderkey, 'amounts', CAST(value + 1 AS VARCHAR) || ' (' || ru || ')' FROM t WHERE wrong")
def needs_review(spark, sf_dir):
    return fields.needs_review(_sentence_hits(spark, sf_dir)).select("o_orderkey", "field", "raw")


# --- metrics ---------------------------------------------------------------

NORMAL = """lower(array_to_string(list_filter(list_transform(string_split(translate(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))), '‐‑‒–—―«»„“”‟‘’' || chr(173), '------""""""""'), chr(10)),
  lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)))"""


@query(f"SELECT doc_id, md5({NORMAL}) AS normalized, length({NORMAL}) AS chars FROM documents")
def metric_normalize(spark, sf_dir):
    value = table(spark, sf_dir, "documents").select("doc_id", tx.normalize_for_metric(F.col("text")).alias("v"))
    return value.select("doc_id", F.md5(F.col("v").cast("binary")).alias("normalized"), F.length("v").cast("bigint").alias("chars"))


def _trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _rated(a: str, b: str, edits: str, length: str) -> str:
    return f"CASE WHEN {a} = '' THEN CASE WHEN {b} = '' THEN 0.0 ELSE 1.0 END WHEN {b} = '' THEN 1.0 ELSE ({edits}) / {length} END"


def _cer(a: str, b: str) -> str:
    """The changes of ``inputs.PAIRS`` replace letters, or one text is the other with characters left out."""
    return _rated(a, b, f"CASE WHEN v = 1 THEN length({b}) - length(replace({b}, '¤', '')) ELSE abs(length({a}) - length({b})) END", f"length({a})")


def _wer(a: str, b: str) -> str:
    listed = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
    own, other = listed.format(a), listed.format(b)
    return _rated(a, b, f"CASE WHEN v = 1 THEN len(list_filter({other}, lambda w: contains(w, '¤'))) ELSE abs(len({own}) - len({other})) END", f"len({own})")


DIGITS_OF = "array_to_string(regexp_extract_all({0}, '[0-9]+'), ' ')"
PAIRED = f"p AS (SELECT *, CAST(name AS BIGINT) % 5 AS v FROM ({duck(inputs.PAIRS)})), t AS (SELECT *, {_trimmed('gt_text')} AS a, {_trimmed('pred_text')} AS b FROM p)"


@query(f"WITH {PAIRED} SELECT name, round({_cer('a', 'b')}, 9) AS cer FROM t")
def cer_eval(spark, sf_dir):
    return shared(spark, sf_dir, inputs.PAIRS).select("name", F.round(tx.cer(F.col("gt_text"), F.col("pred_text")), 9).alias("cer"))


@query(f"WITH {PAIRED}, d AS (SELECT name, v, {DIGITS_OF.format('gt_text')} AS x, {DIGITS_OF.format('pred_text')} AS y FROM p) SELECT name, round({_cer('x', 'y')}, 9) AS digit_cer FROM d")
def digit_cer(spark, sf_dir):
    return shared(spark, sf_dir, inputs.PAIRS).select("name", F.round(tx.digit_cer(F.col("gt_text"), F.col("pred_text")), 9).alias("digit_cer"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = shared(spark, sf_dir, inputs.PAIRS).withColumn("missing", F.col("pred_text") == "")
    return evaluate.document_metrics(pairs)


METRIC_SQL = f"""{PAIRED}, n AS (SELECT *, {NORMAL.replace("(text,", "(gt_text,")} AS g, {NORMAL.replace("(text,", "(pred_text,")} AS q FROM t),
m AS (SELECT name, pred_text = '' AS missing, {_cer("a", "b")} AS cer_strict, {_wer("a", "b")} AS wer_strict, {_cer("g", "q")} AS cer_norm, {_wer("g", "q")} AS wer_norm, length(g) AS chars_gt, length(q) AS chars_pred FROM n)"""
RATES = ("cer_strict", "wer_strict", "cer_norm", "wer_norm")


@query(f"WITH {METRIC_SQL} SELECT name, missing, {', '.join(f'round({c}, 9) AS {c}' for c in RATES)}, chars_gt, chars_pred FROM m")
def document_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).withColumns({c: F.round(c, 9) for c in RATES})


@query(
    f"""WITH {METRIC_SQL} SELECT count(*) AS docs, CAST(count_if(missing) AS BIGINT) AS missing, CAST(sum(chars_gt) AS BIGINT) AS chars_gt, round(sum(cer_strict * chars_gt) / sum(chars_gt), 6) AS micro_cer_strict,
  round(sum(cer_norm * chars_gt) / sum(chars_gt), 6) AS micro_cer_norm, {', '.join(f'round(avg({c}), 6) AS macro_{c}' for c in RATES)} FROM m"""
)
def micro_macro(spark, sf_dir):
    found = evaluate.summary(_metrics(spark, sf_dir))
    return found.select("docs", F.col("missing").cast("bigint").alias("missing"), "chars_gt", *(F.round(c, 6).alias(c) for c in ("micro_cer_strict", "micro_cer_norm", *(f"macro_{x}" for x in RATES))))


@query(f"WITH {METRIC_SQL} SELECT name, round(cer_norm, 9) AS cer_norm FROM m ORDER BY m.cer_norm DESC, name LIMIT 10")
def worst_n(spark, sf_dir):
    return evaluate.worst(_metrics(spark, sf_dir), 10).select("name", F.round("cer_norm", 9).alias("cer_norm"))


STATS_SQL = """e AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS name, 'bin' AS field, CAST(quality AS VARCHAR) AS value FROM labels UNION SELECT DISTINCT CAST(doc_id AS VARCHAR), 'dates', CAST(toxic AS VARCHAR) FROM labels),
f AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS name, 'bin' AS field, CAST(doc_id % 2 AS VARCHAR) AS value FROM labels UNION SELECT DISTINCT CAST(doc_id AS VARCHAR), 'amounts', '1' FROM labels WHERE doc_id % 3 = 0),
d AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS name FROM labels), k(field) AS (VALUES ('bin'), ('amounts'), ('dates')),
s AS (SELECT d.name, k.field, (SELECT count(*) FROM e WHERE e.name = d.name AND e.field = k.field) AS expected, (SELECT count(*) FROM f WHERE f.name = d.name AND f.field = k.field) AS found,
  (SELECT count(*) FROM e JOIN f USING (name, field, value) WHERE e.name = d.name AND e.field = k.field) AS correct FROM d, k)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("name", F.col("doc_id").cast("string"))

    def part(field: str, value, keep=F.lit(True)) -> DataFrame:
        return rows.filter(keep).select("name", F.lit(field).alias("field"), value.cast("string").alias("value"))

    expected = part("bin", F.col("quality")).unionByName(part("dates", F.col("toxic")))
    found = part("bin", F.col("doc_id") % 2).unionByName(part("amounts", F.lit(1), F.col("doc_id") % 3 == 0))
    return evaluate.field_stats(rows, expected, found)


@query(f"WITH {STATS_SQL} SELECT name, field, expected, found, correct FROM s")
def field_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(
    f"""WITH {STATS_SQL}, t AS (SELECT field, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(found) AS BIGINT) AS found, CAST(sum(correct) AS BIGINT) AS correct FROM s GROUP BY field)
SELECT field, expected, found, correct, CASE WHEN found = 0 THEN 0.0 ELSE correct / found END AS precision, CASE WHEN expected = 0 THEN 0.0 ELSE correct / expected END AS recall,
  CASE WHEN greatest(expected, found) = 0 THEN 1.0 ELSE correct / greatest(expected, found) END AS exact FROM t"""
)
def field_totals(spark, sf_dir):
    return evaluate.field_totals(_stats(spark, sf_dir))


@query("SELECT CAST(d.doc_id AS VARCHAR) AS name, length(coalesce(l.p, '')) AS pred_chars, l.p IS NULL AS missing FROM documents d LEFT JOIN (SELECT doc_id, repeat('x', quality + 1) AS p FROM labels) l USING (doc_id)")
def missing_pred(spark, sf_dir):
    gt = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    pred = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("name"), F.repeat(F.lit("x"), F.col("quality") + 1).alias("text"))
    return evaluate.paired(gt, pred).select("name", F.length("pred_text").cast("bigint").alias("pred_chars"), "missing")


@query("SELECT CAST(d.doc_id AS VARCHAR) AS name FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def extra_pred(spark, sf_dir):
    gt, pred = (table(spark, sf_dir, t).select(F.col("doc_id").cast("string").alias("name")) for t in ("labels", "documents"))
    return evaluate.extra(gt, pred)


@query(
    f"""WITH {PAIRED}, x AS (SELECT name, unnest(string_split(gt_text, chr(10))) AS line, generate_subscripts(string_split(gt_text, chr(10)), 1) AS i FROM p),
y AS (SELECT name, unnest(string_split(pred_text, chr(10))) AS line, generate_subscripts(string_split(pred_text, chr(10)), 1) AS i FROM p),
l AS (SELECT name, i, coalesce(x.line, '') AS gt_line, coalesce(y.line, '') AS pred_line FROM x FULL JOIN y USING (name, i)), f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY i) AS nth FROM l WHERE gt_line <> pred_line)
SELECT name, CAST(i AS INT) AS line, gt_line, pred_line FROM f WHERE nth = 1"""
)
def first_diff(spark, sf_dir):
    return evaluate.first_difference(shared(spark, sf_dir, inputs.PAIRS))


FILES = "SELECT CASE WHEN doc_id % 3 = 2 THEN 'z' || CAST(doc_id AS STRING) ELSE CAST(doc_id - doc_id % 3 AS STRING) END || CASE doc_id % 3 WHEN 1 THEN '.pdf.txt' ELSE '.txt' END AS file, CAST(doc_id AS STRING) AS text FROM {documents}"


@query(f"SELECT name, text FROM (SELECT regexp_replace(file, '(\\.pdf)?\\.txt$', '') AS name, text, row_number() OVER (PARTITION BY regexp_replace(file, '(\\.pdf)?\\.txt$', '') ORDER BY file) AS nth FROM ({duck(FILES)})) WHERE nth = 1")
def prediction_names(spark, sf_dir):
    return files.first_predictions(shared(spark, sf_dir, FILES))


# --- words, lines, pages ---------------------------------------------------

LINES_SQL = f"""{WORDS_SQL}, li AS (SELECT doc_id, page, line_num, string_agg(text, ' ' ORDER BY x0, seq) AS text, avg(conf) AS conf, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY ALL)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines(lines.clean_words(inputs.words(spark, sf_dir)))


@query(f"WITH {LINES_SQL} SELECT doc_id, page, line_num, md5(text) AS text, round(conf + 1e-9, 6) AS conf, x0, y0, x1, y1 FROM li")
def lines_from_words(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "page", "line_num", F.md5(F.col("text").cast("binary")).alias("text"), F.round(F.col("conf") + 1e-9, 6).alias("conf"), "x0", "y0", "x1", "y1")


@query(f"WITH {LINES_SQL}, pc AS (SELECT doc_id, page, avg(conf) AS c FROM li GROUP BY ALL) SELECT doc_id, round(avg(c) + 1e-9, 6) AS mean_conf, count(*) AS pages FROM pc GROUP BY doc_id")
def document_confidence(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    pages = rows.select("doc_id", "page").distinct().withColumn("source", F.lit("ocr"))
    return lines.document_confidence(lines.page_confidence(rows, pages)).withColumn("mean_conf", F.round(F.col("mean_conf") + 1e-9, 6))


@query(f"WITH {LINES_SQL} SELECT doc_id, page, CAST(median(y1 - y0) AS DOUBLE) AS median_height FROM li GROUP BY ALL")
def median_height(spark, sf_dir):
    return lines.median_height(_lines(spark, sf_dir), "doc_id", "page")


@query(f"WITH {LINES_SQL}, pc AS (SELECT doc_id, page, avg(conf) AS c FROM li GROUP BY ALL) SELECT doc_id, page, 'low_confidence_page' AS type FROM pc WHERE c < {gates.LOW_CONFIDENCE} - 1e-12")
def low_confidence(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    pages = rows.select("doc_id", "page").distinct().withColumn("source", F.lit("ocr"))
    scored = lines.page_confidence(rows, pages).withColumns({"n_blocks": F.lit(1), "mean_conf": F.col("mean_conf") + 1e-12})
    return gates.low_confidence(scored).select("doc_id", "page", "type")


REFINE = """SELECT l_orderkey, l_linenumber, text, again, conf FROM (SELECT l_orderkey, l_linenumber, CAST(1000 + l_partkey AS STRING) || ',' || CAST(l_linenumber AS STRING) AS text,
  CASE l_linenumber % 3 WHEN 0 THEN CAST(1000 + l_suppkey AS STRING) || '.' || CAST(l_linenumber AS STRING) WHEN 1 THEN '' ELSE '7' END AS again, l_discount * 10 AS conf FROM {lineitem})"""


@query(
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN again <> '' AND length(regexp_replace(again, '[^0-9]', '', 'g')) = length(regexp_replace(text, '[^0-9]', '', 'g')) THEN again ELSE text END AS text
FROM ({duck(REFINE)}) WHERE conf <= 0.92"""
)
def digit_refine(spark, sf_dir):
    return gates.digit_words(shared(spark, sf_dir, REFINE)).select("l_orderkey", "l_linenumber", gates.refined(F.col("text"), F.col("again")).alias("text"))


RUNS = "SELECT CAST(l_orderkey AS STRING) AS doc_id, CASE WHEN l_linenumber % 3 = 0 THEN 'text_layer' ELSE 'ocr' END AS source, l_returnflag = 'R' AS failed FROM {lineitem}"


@query(f"SELECT doc_id, CAST(count_if(source = 'ocr') AS BIGINT) AS ocr_pages, CAST(count_if(source = 'ocr' AND failed) AS BIGINT) AS failed_pages FROM ({duck(RUNS)}) GROUP BY doc_id HAVING count_if(source = 'ocr') > 0 AND count_if(source = 'ocr' AND failed) >= count_if(source = 'ocr')")
def failed_documents(spark, sf_dir):
    found = gates.failed_documents(shared(spark, sf_dir, RUNS))
    return found.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("ocr_pages", "failed_pages")))


SIZES = "SELECT p_partkey, p_size * 60.0 AS w, p_size * 80.0 AS h, 300 AS dpi, CAST(p_size % 50 AS DOUBLE) AS xh, p_size * 50 AS pw, p_size * 70 AS ph FROM {part}"


@query(
    f"""SELECT p_partkey, CAST(CASE WHEN (w / 72 * 300) * (h / 72 * 300) <= 40000000 THEN 300 ELSE greatest(72, floor(300 * sqrt(40000000 / ((w / 72 * 300) * (h / 72 * 300))))) END AS INT) AS dpi,
  round(CASE WHEN xh = 0 OR xh BETWEEN 18 AND 48 THEN 1.0 ELSE greatest(0.4, least(3.0, 30.0 / xh)) END, 9) AS scale FROM ({duck(SIZES)})"""
)
def page_sizing(spark, sf_dir):
    rows = shared(spark, sf_dir, SIZES)
    scale = gates.resize_scale(F.col("xh"), F.lit(100), F.lit(100))
    return rows.select("p_partkey", gates.capped_dpi(F.col("w"), F.col("h"), F.col("dpi")).alias("dpi"), F.round(scale, 9).alias("scale"))


GLYPHS = "SELECT l_suppkey AS page, CAST(l_quantity AS INT) % 30 + 1 AS w, CAST(l_quantity AS INT) + 2 AS h, CAST(l_partkey % 900 AS INT) AS area FROM {lineitem}"


@query(
    f"""SELECT page, CASE WHEN count_if(ok) >= 20 THEN median(h) FILTER (WHERE ok) ELSE 0.0 END AS xheight
FROM (SELECT *, h BETWEEN 4 AND 200 AND w >= 2 AND w <= 6 * h AND NOT (h > 6 * w AND h > 40) AND area >= 0.15 * w * h AS ok FROM ({duck(GLYPHS)})) GROUP BY page"""
)
def x_height(spark, sf_dir):
    return gates.xheight(shared(spark, sf_dir, GLYPHS), "page")


# --- layout ----------------------------------------------------------------

SPANS = "SELECT l_orderkey AS g, CAST(l_partkey % 900 AS INT) AS lo, CAST(l_partkey % 900 AS INT) + CAST(l_quantity AS INT) AS hi FROM {lineitem}"


@query(
    f"""WITH s AS ({duck(SPANS)}), r AS (SELECT *, max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT g, CAST(floor((reach + lo) / 2) AS BIGINT) AS cut FROM r WHERE lo > reach AND lo - reach >= 30"""
)
def gaps_cuts(spark, sf_dir):
    return intervals.gap_cuts(shared(spark, sf_dir, SPANS), ["g"], F.lit(30))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 25 THEN 1 ELSE 2 END AS INT) AS bucket, CAST(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 ELSE 2 END AS INT) AS band FROM lineitem")
def column_bucket(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", intervals.bucket_of(q, F.array(F.lit(10.0), F.lit(25.0), F.lit(40.0))).alias("bucket"), intervals.band_of(q, F.array(F.lit(10.0), F.lit(25.0))).alias("band"))


COLUMN_LINES = "SELECT l_orderkey AS page, CAST(l_linenumber % 3 AS INT) AS col, l_linenumber AS line_id, CAST(l_partkey % 40 AS INT) AS y0, CAST(l_partkey % 40 AS INT) + 8 AS y1 FROM {lineitem}"


@query(
    f"""WITH c AS ({duck(COLUMN_LINES)}), z AS (SELECT page, col, count(*) AS n FROM c GROUP BY ALL), a AS (SELECT page, arg_min(col, -n * 10 + col) AS anchor, max(n) AS lines, count(*) AS columns FROM z GROUP BY page),
b AS (SELECT c.page, c.line_id, count(DISTINCT o.col) AS met FROM c JOIN a ON a.page = c.page AND c.col = a.anchor JOIN c o ON o.page = c.page AND o.col <> c.col AND least(c.y1, o.y1) - greatest(c.y0, o.y0) > 0.4 * 8 GROUP BY ALL),
p AS (SELECT a.page, count(b.line_id) AS paired FROM a LEFT JOIN b ON b.page = a.page AND b.met = a.columns - 1 GROUP BY a.page)
SELECT page, anchor, CASE WHEN columns > 1 THEN paired / lines ELSE 0.0 END AS ratio FROM a JOIN p USING (page)"""
)
def pairing_ratio(spark, sf_dir):
    return intervals.pairing_ratio(shared(spark, sf_dir, COLUMN_LINES), ["page"])


@query(
    f"""WITH c AS ({duck(COLUMN_LINES)}), s AS (SELECT page, col, min(y0) AS y0, max(y1) AS y1 FROM c GROUP BY ALL), n AS (SELECT *, lead(y0) OVER w AS n0, lead(y1) OVER w AS n1 FROM s WINDOW w AS (PARTITION BY page ORDER BY col))
SELECT page, coalesce(bool_and(least(y1, n1) - greatest(y0, n0) >= 0.5 * least(y1 - y0, n1 - n0)) FILTER (WHERE n0 IS NOT NULL), true) AS parallel FROM n GROUP BY page"""
)
def parallel_columns(spark, sf_dir):
    spans = shared(spark, sf_dir, COLUMN_LINES).groupBy("page", "col").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return intervals.parallel_columns(spans, ["page"])


@query(f"WITH c AS ({duck(COLUMN_LINES)}) SELECT a.page, a.line_id AS a_id, b.line_id AS b_id, round((least(a.y1, b.y1) - greatest(a.y0, b.y0)) / 8, 6) AS ratio FROM c a JOIN c b ON a.page = b.page AND a.col = 0 AND b.col = 1 WHERE least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.4 * 8")
def overlap_join(spark, sf_dir):
    rows = shared(spark, sf_dir, COLUMN_LINES)
    a = rows.filter("col = 0").select("page", F.col("line_id").alias("a_id"), F.col("y0").alias("a0"), F.col("y1").alias("a1"))
    b = rows.filter("col = 1").select("page", F.col("line_id").alias("b_id"), F.col("y0").alias("b0"), F.col("y1").alias("b1"))
    return intervals.overlap_join(a, b, ["page"], 16).select("page", "a_id", "b_id", F.round("ratio", 6).alias("ratio"))


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.blocks(lines.page_lines(_lines(spark, sf_dir)))


@query()
def xy_cut(spark, sf_dir):
    rows = _blocked(spark, sf_dir).select("doc_id", "page", F.posexplode("blocks").alias("seq", "b"))
    return rows.select("doc_id", "page", "seq", "b.kind", F.size("b.columns").alias("columns"), F.size("b.lines").alias("lines"))


# --- rendering -------------------------------------------------------------


@query("SELECT conv_id, regexp_replace(string_agg(text, chr(10) ORDER BY turn), '^\\s+|\\s+$', '', 'g') || chr(10) AS text FROM conversations GROUP BY conv_id")
def render_document(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return render.documents(rows).withColumnRenamed("doc_id", "conv_id")


HYPHENS = "SELECT doc_id, replace(text, 'a ', '-' || chr(10)) AS text FROM {documents}"


@query(f"SELECT doc_id, md5(regexp_replace(text, '[-\\x{{AD}}]+\\n(\\p{{Ll}})', '\\1', 'g')) AS text FROM ({duck(HYPHENS)})")
def hyphen_join(spark, sf_dir):
    return shared(spark, sf_dir, HYPHENS).select("doc_id", F.md5(render.join_hyphens(F.col("text")).cast("binary")).alias("text"))


HEADS = "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '- ' || CAST(l_partkey % 10000 AS STRING) || ' -' WHEN 1 THEN 'стр. ' || CAST(l_linenumber AS STRING) WHEN 2 THEN CAST(10000 + l_partkey AS STRING) ELSE 'бет x' END AS text FROM {lineitem}"


@query(f"SELECT l_orderkey, l_linenumber, l_linenumber % 4 < 2 AS is_number FROM ({duck(HEADS)})")
def page_numbers(spark, sf_dir):
    return shared(spark, sf_dir, HEADS).select("l_orderkey", "l_linenumber", tx.is_page_number(F.col("text")).alias("is_number"))


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocked(spark, sf_dir)
    return rows.select("doc_id", "page", F.lit("ocr").alias("source"), F.lit(1230).alias("height"), F.lit(None).cast("string").alias("raw_text"), "blocks")


@query()
def render_grid(spark, sf_dir):
    rows = render.all_profiles(_page_rows(spark, sf_dir))
    return rows.groupBy("render").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query()
def process_documents(spark, sf_dir):
    words = inputs.words(spark, sf_dir)
    pages = words.select("doc_id", "page").distinct().withColumns({"height": F.lit(1230), "raw_text": F.lit(None).cast("string"), "coverage": F.lit(0.0)})
    done = process.process(process.assessed(pages), words)
    return done.documents.select("doc_id", F.length("text").alias("chars"), F.round("mean_conf", 6).alias("mean_conf"), F.size("fields.bin").alias("bins"), F.size("fields.amounts").alias("amounts"), F.size("fields.dates").alias("dates"))


# --- engines ---------------------------------------------------------------


@query()
def arbitration(spark, sf_dir):
    rows = inputs.page_lines(spark, sf_dir)
    other = F.transform("lines", lambda x: F.struct(F.lit("second").alias("engine"), F.transform(x["words"], lambda w: F.struct(F.replace(F.replace(w["text"], F.lit("h"), F.lit("n")), F.lit("0"), F.lit("8")).alias("text"), w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["y1"].alias("y1"), F.lit(0.5).alias("conf"))).alias("words")))
    done = arbitrate.decided(rows.select("doc_id", "page", F.col("lines").alias("primary"), other.alias("secondary")))
    return done.select("doc_id", "page", F.size("chosen").alias("lines"), F.size("messages").alias("disagreements"))


@query(f"SELECT o_orderkey, ru AS text FROM ({duck(inputs.NUMERALS)})")
def homoglyphs(spark, sf_dir):
    rows = shared(spark, sf_dir, f"SELECT o_orderkey, translate(ru, 'аео', 'aeo') AS text FROM ({inputs.NUMERALS})")
    return rows.select("o_orderkey", tx.normalize_text("text").alias("text"))


@query(
    f"""WITH {PAIRED}, n AS (SELECT name, length(gt_text) AS m, length(pred_text) AS k, CASE WHEN v = 1 THEN length(replace(pred_text, '¤', '')) ELSE least(length(gt_text), length(pred_text)) END AS common FROM p)
SELECT name, round(CASE WHEN m + k = 0 THEN 1.0 ELSE 2 * common / (m + k) END, 9) AS ratio FROM n"""
)
def indel_similarity(spark, sf_dir):
    return shared(spark, sf_dir, inputs.PAIRS).select("name", F.round(tx.indel_ratio("gt_text", "pred_text"), 9).alias("ratio"))


BOXES = "SELECT doc_id, CAST(doc_id % 50 AS INT) AS x FROM {documents}"


@query(
    f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(seq AS INT) AS seq, CASE seq WHEN 0 THEN 'box' ELSE 'polygon' END AS text, CAST(x + seq AS INT) AS x0, CAST(x + 10 + seq AS INT) AS x1, CASE seq WHEN 0 THEN 0.9 ELSE 0.0 END AS conf
FROM ({duck(BOXES)}), (VALUES (0), (1)) AS s(seq)"""
)
def detector_words(spark, sf_dir):
    x = F.col("x")

    def point(a, b):
        return F.array(a.cast("double"), b.cast("double"))

    rows = shared(spark, sf_dir, BOXES).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("page"), F.lit("detector").alias("engine"), F.array(F.lit(" box "), F.lit("polygon"), F.lit("neither"), F.lit(" ")).alias("rec_texts"), F.array(F.lit(0.9)).alias("rec_scores"),
        F.array(F.array(x, F.lit(1), x + 10, F.lit(9))).alias("rec_boxes"), F.array(F.lit(None).cast("array<array<double>>"), F.array(point(x + 1, F.lit(1)), point(x + 11, F.lit(2)), point(x + 5, F.lit(9)))).alias("rec_polys"),
    )
    return files.detector_words(rows).select("doc_id", "seq", "text", "x0", "x1", "conf")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(seq AS INT) AS seq, w AS text, CAST(seq * 10 AS INT) AS x0, CAST(seq * 10 + 8 AS INT) AS x1 FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS seq FROM documents)")
def engine_words(spark, sf_dir):
    w = F.split("text", " ")
    at = F.sequence(F.lit(0), F.size(w) - 1)
    zero, ten = F.transform(at, lambda i: i * 0), F.transform(at, lambda i: i * 10)
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("page"), F.lit("engine").alias("engine"), w.alias("text"), zero.alias("conf"), zero.alias("block_num"), zero.alias("par_num"), zero.alias("line_num"),
        ten.alias("left"), zero.alias("top"), F.transform(at, lambda i: i * 0 + 8).alias("width"), zero.alias("height"),
    )
    return files.engine_words(rows).select("doc_id", "seq", "text", "x0", "x1")


@query("SELECT doc_id, CAST(i - 1 AS INT) AS page, md5(part) AS raw_text FROM (SELECT doc_id, unnest(string_split(text, 'the')) AS part, generate_subscripts(string_split(text, 'the'), 1) AS i, len(string_split(text, 'the')) AS n FROM documents) WHERE i < n OR part <> ''")
def page_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "the", "\f").alias("text"))
    return files.page_texts(rows).select("doc_id", "page", F.md5(F.col("raw_text").cast("binary")).alias("raw_text"))


@query("SELECT l_orderkey AS doc_id, CAST(0 AS INT) AS page, round(least(1.0, max(l_extendedprice / 100 * 0.72 * l_quantity * 7.2 / (595.0 * 842.0))), 9) AS coverage FROM lineitem GROUP BY l_orderkey")
def image_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    images = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), (F.col("l_extendedprice") / 100).alias("width"), F.col("l_quantity").alias("height"), F.lit(100.0).alias("x_dpi"), F.lit(10.0).alias("y_dpi"))
    pages = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page")).distinct().withColumns({"width_pt": F.lit(595.0), "height_pt": F.lit(842.0)})
    return files.image_coverage(images, pages).withColumn("coverage", F.round("coverage", 9))


@query("SELECT o_custkey AS doc_id, count(*) AS n_pages FROM orders GROUP BY o_custkey HAVING count(*) <= 12")
def page_guard(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").alias("n_pages"))
    return files.within_pages(counts, 12)


# --- comparisons of runs, reports, service ---------------------------------

BAKE = "SELECT o_orderpriority AS profile, o_totalprice / 1000000 AS cer_norm, o_custkey AS chars_gt, o_totalprice / 2000000 AS digit_cer, o_totalprice / 1000 AS elapsed, CAST(o_orderkey % 4 AS BIGINT) AS pages, o_orderstatus = 'F' AS failed FROM {orders}"
BAKE_SQL = f"""k AS (SELECT profile, sum(cer_norm * chars_gt) FILTER (WHERE NOT failed) / sum(chars_gt) FILTER (WHERE NOT failed) AS cer_norm, avg(digit_cer) FILTER (WHERE NOT failed) AS digit_cer,
  sum(elapsed) FILTER (WHERE NOT failed) / sum(pages) FILTER (WHERE NOT failed) AS s_per_page, CAST(sum(pages) FILTER (WHERE NOT failed) AS BIGINT) AS pages, CAST(count_if(failed) AS BIGINT) AS failures FROM ({duck(BAKE)}) GROUP BY profile)"""


@query(f"WITH {BAKE_SQL} SELECT profile, round(cer_norm, 9) AS cer_norm, round(digit_cer, 9) AS digit_cer, round(s_per_page, 6) AS s_per_page, pages, failures FROM k")
def bakeoff(spark, sf_dir):
    found = evaluate.bakeoff(shared(spark, sf_dir, BAKE))
    return found.select("profile", F.round("cer_norm", 9).alias("cer_norm"), F.round("digit_cer", 9).alias("digit_cer"), F.round("s_per_page", 6).alias("s_per_page"), "pages", F.col("failures").cast("bigint").alias("failures"))


@query(f"WITH {BAKE_SQL} SELECT arg_min(profile, cer_norm) AS best_cer_norm, arg_min(profile, digit_cer) AS best_digit_cer, arg_min(profile, s_per_page) AS best_s_per_page FROM k WHERE pages > 0")
def best_of(spark, sf_dir):
    return evaluate.best_of(evaluate.bakeoff(shared(spark, sf_dir, BAKE)))


TIMES = "SELECT o_orderpriority AS config, CAST(month(o_orderdate) AS INT) AS workers, sum(o_custkey) AS elapsed FROM {orders} GROUP BY o_orderpriority, CAST(month(o_orderdate) AS INT)"


@query(f"SELECT config, workers, round(first_value(elapsed) OVER (PARTITION BY config ORDER BY workers) / elapsed, 9) AS speedup FROM ({duck(TIMES)})")
def speedup(spark, sf_dir):
    return evaluate.speedup(shared(spark, sf_dir, TIMES)).select("config", "workers", F.round("speedup", 9).alias("speedup"))


@query(
    f"""WITH {METRIC_SQL}, {STATS_SQL},
w AS (SELECT name, {", ".join(f"CAST(sum({c}) FILTER (WHERE field = '{k}') AS BIGINT) AS {k}_{c}" for k in FIELD_KEYS for c in ("expected", "found", "correct"))} FROM s GROUP BY name)
SELECT m.name, CAST(missing AS INT) AS missing, {", ".join(f"printf('%.6f', {c}) AS {c}" for c in RATES)}, chars_gt, chars_pred, {", ".join(f"coalesce({k}_{c}, 0) AS {k}_{c}" for k in FIELD_KEYS for c in ("expected", "found", "correct"))} FROM m LEFT JOIN w USING (name)"""
)
def report_csv(spark, sf_dir):
    return sinks.csv_rows(_metrics(spark, sf_dir), _stats(spark, sf_dir))


@query()
def report_json(spark, sf_dir):
    return sinks.document_records(_metrics(spark, sf_dir), _stats(spark, sf_dir))


JOBS = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'accepted' ELSE 'done' END AS status, CASE WHEN event_id % 4 > 1 THEN value END AS expires_at FROM {events}"


@query(f"SELECT count(*) AS total, CAST(count_if(status = 'running') AS BIGINT) AS running FROM ({duck(JOBS)}) WHERE expires_at IS NULL OR expires_at > 50")
def queue_summary(spark, sf_dir):
    return jobs.queue_summary(shared(spark, sf_dir, JOBS), 50).select("total", F.col("running").cast("bigint").alias("running"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return jobs.event_windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
