"""Column expressions against the scanner, layout, rendering, arbitration, files, queue."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import dates, fields, identifiers, numerals, scanner
from quillstone.functions import text as tx
from quillstone.functions.text import similarity
from quillstone.operators import arbitrate, evaluate, gates, imaging, layout, lines, process, render
from quillstone.plans import catalog, inputs
from quillstone.sources import files, recognition, sinks
from quillstone.streaming import jobs


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_identifier_columns_agree_with_the_scanner(spark):
    numbers = [f"{n * 104729 + 10**11:012d}" for n in range(400)]
    rows = identifiers.with_repair(spark.createDataFrame([(n,) for n in [*numbers, "12", "12345678901a"]], "n string"), "n", "r")
    for r in rows.select("n", "r.*", identifiers.looks_structural(F.col("n")).alias("st")).collect():
        if r.n in numbers:
            valid = scanner.valid_identifier(r.n)
            others = [r.n] if valid else scanner.substitutes(r.n)
            assert r.candidates == others and r.st == scanner.structural(r.n)
            assert r.status == ("valid" if valid else {0: "invalid", 1: "fixed"}.get(len(others), "ambiguous"))
        else:
            assert r.status == "invalid" and r.candidates == []


def test_confidences_only_order_candidates(spark):
    number = next(n for n in (f"{i * 104729 + 10**11:012d}" for i in range(4000)) if not scanner.valid_identifier(n) and len(scanner.substitutes(n)) > 1)
    confs = [1.0 - i / 100 for i in range(12)]
    df = identifiers.with_repair(spark.createDataFrame([(number, confs)], "n string, c array<double>"), "n", "r", "c")
    assert sorted(values(df.select("r.candidates"), "candidates")[0]) == sorted(scanner.substitutes(number))


TEXTS = ["12.01.2026 и 31.02.2026", "«15» марта 2024 года; 5 дней 2024", "x 2026-09-21 1.2.0000", "", None, "12 қаңтар 2026 жыл"]


def test_date_columns_agree_with_the_scanner(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", dates.numeric_dates(F.col("t")).alias("n"), dates.textual_dates(F.col("t")).alias("w")).collect():
        assert sorted((x.raw.strip(), x.value) for x in [*r.n, *r.w]) == sorted((h.raw.strip(), h.iso) for h in scanner.dates(r.t or ""))


def test_number_columns(spark):
    df = spark.createDataFrame([("бес жүз мың", "один миллион двести пятьдесят тысяч", "1.250.000"), ("емес", "пятьсот квадрокоптеров", "1 250 000,00"), ("", "", "x")], "k string, r string, d string")
    rows = df.select(numerals.words_to_number(F.col("k"), "kk").alias("k"), numerals.words_to_number(F.col("r"), "ru").alias("r"), numerals.parse_digits(F.col("d")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [(500000, 1250000, 1250000), (None, None, 1250000), (None, None, None)]


def test_numerals_of_both_languages_are_told_apart():
    for language in ("ru", "kk"):
        assert numerals.tables(language)


def test_fields_hits_review_and_sql(spark):
    docs = spark.createDataFrame([("a", "500 000 (шестьсот тысяч) тенге, 31.02.2026, 12.01.2026, 184959310345"), ("b", None)], "doc_id string, text string")
    hits = fields.field_hits(docs)
    assert {(r.field, r.value) for r in hits.collect()} >= {("amounts", "500000"), ("dates", "2026-01-12"), ("bin", "184959310345")}
    assert {r.field for r in fields.needs_review(hits).collect()} == {"amounts", "dates"}
    fields.register(spark)
    docs.createOrReplaceTempView("docs_t")
    assert spark.sql("SELECT control_digit('18495931034') AS c, word_error_rate('a b', 'a c') AS w FROM docs_t LIMIT 1").first().asDict() == {"c": 5, "w": 0.5}
    assert spark.sql("SELECT * FROM field_hits('12.01.2026')").first().value == "2026-01-12"


def test_metric_normalization_and_rates(spark):
    df = spark.createDataFrame([("А  б\r\n\r\n «x» — Y", "а б\n\"x\" - y"), ("", ""), ("", "q"), ("abcd", "abxd")], "a string, b string")
    rows = df.select(tx.normalize_for_metric(F.col("a")).alias("n"), tx.cer(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0].n == 'а б\n"x" - y' and [r.c for r in rows[1:]] == [0.0, 1.0, 0.25]
    with pytest.raises(ValueError):
        tx.normalize_for_metric(F.col("a"), "other")


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_of_characters_and_words():
    rng = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(14))) for _ in range(2))
        assert tx.edit_distance(a, b) == plain_distance(a, b)
        assert tx.edit_distance(a.split(), b.split()) == plain_distance(a.split(), b.split())
    assert tx.edit_distance("a b c d".split(), "a x c".split()) == 2
    long = "ab c" * 20_000
    assert tx.edit_distance(long + "x", "y" + long) == 2


def test_error_rates_of_whole_texts(spark):
    """Texts of any length and script, against the plain table."""
    rng = random.Random(4)
    rows = [("".join(rng.choice("аб ё\n") for _ in range(rng.randrange(900))), "".join(rng.choice("аб ё\n") for _ in range(rng.randrange(900)))) for _ in range(6)]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("c", tx.cer(F.col("a"), F.col("b"))).withColumn("w", tx.word_error_rate("a", "b"))
    for r in df.collect():
        a, b = r.a.strip(), r.b.strip()
        assert r.c == pytest.approx(plain_distance(a, b) / len(a) if a and b else float(bool(a) or bool(b)))
        assert r.w == pytest.approx(plain_distance(a.split(), b.split()) / len(a.split()) if a.split() and b.split() else float(bool(a.split()) or bool(b.split())))


def test_udfs_run_once_under_filters(spark):
    """A filter on what a UDF finds doesn't make it run a second time."""
    df = spark.createDataFrame([("a", "12.01.2026")], "doc_id string, text string")
    for plan in (fields.with_fields(df).filter(F.size("fields.dates") > 0), fields.needs_review(fields.field_hits(df)), df.select(F.explode(fields.validate_text("text")).alias("w"))):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("ArrowEvalPython") + text.count("MapInArrow") == 1


def box(text, x0, y0, w=30, h=10, conf=0.9):
    return (text, x0, y0, x0 + w, y0 + h, conf)


def test_columns_and_tables():
    two = [layout.Line([box("l", 0, y), box("l", 40, y)]) for y in (0, 14, 28)] + [layout.Line([box("r", 300, y), box("r", 340, y)]) for y in (0, 14, 28)]
    found = layout.xy_cut(two)
    assert [b.kind for b in found] == ["table"] and len(found[0].lines) == 3 and found[0].columns == [(0, 70), (300, 370)]
    shifted = [layout.Line([box("l", 0, y), box("l", 40, y)]) for y in (0, 14, 28)] + [layout.Line([box("r", 300, y), box("r", 340, y)]) for y in (7, 21, 35)]
    assert [b.kind for b in layout.xy_cut(shifted)] in (["table"], ["text", "text"])
    rows = [layout.Line([box("a", 0, y), box("b", 300, y)]) for y in (0, 14, 28)]
    assert layout.xy_cut(rows)[0].columns == [(0, 30), (300, 330)]
    far = [layout.Line([box("top", 0, 0)]), layout.Line([box("end", 0, 100)])]
    assert [b.lines[0].words[0][0] for b in layout.xy_cut(far)] == ["top", "end"]
    assert layout.xy_cut([]) == []
    assert layout.find_cuts([(0, 10), (5, 8), (20, 30), (30, 31), (60, 70)], 5) == [15, 45]


def test_whole_flow(spark):
    rows = []
    for page, (y, words) in enumerate([(5, ["стр.", "1"]), (5, ["Сумма", "500", "000", "тенге"])]):
        rows += [("d", page, 1, 1, 1, i, w, i * 40, y, i * 40 + 30, y + 10, 60.0, "e") for i, w in enumerate(words)]
    rows += [("d", 1, 1, 1, 2, 0, " ", 0, 50, 10, 60, 90.0, "e"), ("d", 1, 1, 1, 2, 1, "bad", 0, 50, 10, 60, -1.0, "e")]
    schema = "doc_id string, page int, block_num int, par_num int, line_num int, seq int, text string, x0 int, y0 int, x1 int, y1 int, conf double, engine string"
    words = spark.createDataFrame(rows, schema)
    pages = spark.createDataFrame([("d", 0, 1000, None, 0.0), ("d", 1, 1000, "", 0.0), ("d", 2, 1000, "слово " * 20, 0.0)], "doc_id string, page int, height int, raw_text string, coverage double")
    done = process.process(process.assessed(pages), words, "no-headers")
    doc = done.documents.first()
    assert doc.text == ("слово " * 20).strip() + "\n" and doc.fields.amounts == []  # both lines are short and at the top
    kinds = sorted(r.type for r in done.warnings.collect())
    assert kinds.count("low_confidence_page") == 2 and kinds.count("text_layer_rejected") == 2
    full = process.process(process.assessed(pages), words)
    assert full.documents.first().text.startswith("стр. 1\nСумма 500 000 тенге\nслово")


def test_profiles_differ(spark):
    word = "struct<text:string,x0:int,y0:int,x1:int,y1:int,conf:double>"
    block = f"array<struct<kind:string,columns:array<struct<x0:int,x1:int>>,lines:array<struct<engine:string,words:array<{word}>>>>>"
    table = ("table", [(0, 30), (100, 130)], [("e", [box("a", 0, 500), box("b", 100, 500)])])
    para = ("text", [], [("e", [box("дого-", 0, 520)]), ("e", [box("вор", 0, 535)])])
    docs = spark.createDataFrame([("d", 0, "ocr", 1000, None, [table, para])], f"doc_id string, page int, source string, height int, raw_text string, blocks {block}")
    texts = {r.render: r.text for r in render.all_profiles(docs).collect()}
    assert texts["default"] == "a\tb\n\nдого-\nвор\n" and texts["pipe"].startswith("a | b") and texts["cells"].startswith("a\nb")
    assert texts["flat"] == "a b\nдоговор\n" and texts["joined"] == "a\tb\n\nдоговор\n"


def test_arbitration():
    def line(text, y, conf, engine="e"):
        return {"engine": engine, "words": [{"text": text, "x0": 0, "y0": y, "x1": 9, "y1": y + 10, "conf": conf}]}

    found = arbitrate.arbitrate([line("слово", 0, 0.5), line("15", 20, 0.5)], [line("слава", 1, 0.9, "f"), line("16", 20, 0.9, "f"), line("new", 60, 0.7, "f"), line("weak", 90, 0.1, "f")])
    assert [x["words"][0]["text"] for x in found["lines"]] == ["слава", "15", "new"]
    assert found["messages"] == ["цифры расходятся: e=['15'] vs f=['16']"]
    assert arbitrate.arbitrate([line("a", 0, 1.0)], [])["messages"] == []


def test_most_similar_line():
    rng = random.Random(4)
    for _ in range(3000):
        text, *others = ("".join(rng.choices("abcd", k=rng.randint(0, 6))) for _ in range(rng.randint(1, 6)))
        at, score = max(((i, similarity(text, t)) for i, t in enumerate(others)), key=lambda m: m[1], default=(None, 0.0))
        assert arbitrate.likest(text, list(enumerate(others))) == (at if score > 0 else None)


def test_arbitration_of_pages(spark, tmp_path):
    """Texts of documents go through one shuffle and Python never sees a word's box: before, words were shuffled twice and all were Python objects at once."""
    rng = random.Random(5)
    texts = ["\n".join(" ".join(rng.choices(["the", "40", "hat", "\u00a0x ", "", "0th"], k=rng.randint(0, 9))) for _ in range(rng.randint(1, 99))) for _ in range(20)]
    docs = [(i if i < 15 else 3, t) for i, t in enumerate(texts)] + [(30, ""), (31, None), (None, "the")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = inputs.page_lines(spark, str(tmp_path))
    plain = lines.page_lines(lines.lines(lines.clean_words(inputs.words(spark, str(tmp_path)))))
    assert made.schema["lines"].dataType.simpleString() == plain.schema["lines"].dataType.simpleString()
    listed = {(r.doc_id, r.page): r.lines for r in made.collect()}
    assert listed == {(r.doc_id, r.page): r.lines for r in plain.collect()}

    query = catalog.queries()["arbitration"](spark, str(tmp_path))
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert "x0" not in plan.split("MapInArrow")[0] and plan.count("Aggregate") == 1
    assert len([x for x in plan.splitlines() if "regexp_replace" in x]) == 1  # words are made once
    other = F.transform("lines", lambda x: F.struct(F.lit("second").alias("engine"), F.transform(x["words"], lambda w: F.struct(F.translate(w["text"], "th0", "tn8").alias("text"), *(w[c].alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit(0.5).alias("conf"))).alias("words")))
    pages = made.select("doc_id", "page", F.col("lines").alias("primary"), other.alias("secondary"))
    pages = pages.unionByName(pages.orderBy("doc_id", "page").limit(1).withColumns({"doc_id": F.lit("none"), "primary": F.lit(None).cast(pages.schema["primary"].dataType)}))
    expected = {(r.doc_id, r.page): arbitrate.arbitrate(r.primary, r.secondary) for r in pages.collect()}
    found = {(r.doc_id, r.page): {"lines": r.lines, "messages": r.messages} for r in arbitrate.agreed(pages).collect()}
    assert found == expected
    assert {(r.doc_id, r.page): (r.lines, r.disagreements) for r in query.collect()} == {k: (len(v["lines"]), len(v["messages"])) for k, v in expected.items() if k[0] != "none"}


def test_evaluation_over_files(spark, tmp_path):
    gt, pred = tmp_path / "gt", tmp_path / "pred"
    gt.mkdir(), pred.mkdir()
    (gt / "a.txt").write_text("Сумма 500 000 тенге 12.01.2026", encoding="utf-8")
    (gt / "b.txt").write_text("пусто", encoding="utf-8")
    (gt / "a.fields.json").write_text('{"bin": [], "amounts": ["500000"], "dates": ["2026-01-12"]}', encoding="utf-8")
    (pred / "a.pdf.txt").write_text("Сумма 500 000 тенге 12.01.2026", encoding="utf-8")
    (pred / "a.txt").write_text("второй", encoding="utf-8")
    (pred / "z.txt").write_text("лишний", encoding="utf-8")
    truth, guess = files.ground_truth(spark, str(gt)), files.predictions(spark, str(pred))
    pairs = evaluate.paired(truth, guess)
    metrics = {r.name: r for r in evaluate.document_metrics(pairs).collect()}
    assert metrics["a"].cer_norm == 0.0 and metrics["b"].cer_norm == 1.0 and metrics["b"].missing
    assert values(evaluate.extra(truth, guess), "name") == ["z"]
    stats = evaluate.field_stats(truth, files.sidecars(spark, str(gt)), evaluate.values_of(pairs, "pred_text"))
    assert {(r.field, r.correct, r.exact) for r in evaluate.field_totals(stats).collect()} == {("bin", 0, 1.0), ("amounts", 1, 1.0), ("dates", 1, 1.0)}
    row = sinks.csv_rows(evaluate.document_metrics(pairs), stats).filter("name = 'b'").first()
    assert row.missing == 1 and row.cer_norm == "1.000000" and row.amounts_correct == 0
    assert '"docs":2' in sinks.aggregate_record(evaluate.document_metrics(pairs), stats).first().record
    assert evaluate.first_difference(pairs).first().line == 1
    from quillstone import cli

    assert cli.main(["bench", str(gt), str(pred), str(tmp_path / "out")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "csv")).count() == 2


def test_csv_rounds_like_printf(spark):
    rates = [1 / 640, 87 / 640, 3 / 640, 1 / 128, 3 / 128, 0.0, 1.0, 1 / 3, 12345.0000005, None]
    rows = [(str(i), False, r, r, r, r, 1, 1) for i, r in enumerate(rates)]
    metrics = spark.createDataFrame(rows, "name string, missing boolean, cer_strict double, wer_strict double, cer_norm double, wer_norm double, chars_gt long, chars_pred long")
    stats = spark.createDataFrame([], "name string, field string, expected long, found long, correct long")
    found = {r.name: r.wer_norm for r in sinks.csv_rows(metrics, stats).collect()}
    assert found == {str(i): None if r is None else "%.6f" % r for i, r in enumerate(rates)}
    assert (found["0"], found["1"], found["3"]) == ("0.001563", "0.135937", "0.007812")


def test_gates(spark):
    df = spark.createDataFrame([("мало",), ("only latin letters here, quite a lot of them indeed",), ("слово " * 20,), ("с л о в о " * 20,), ("слово 1234567890 " * 20,), (None,)], "t string")
    assert values(df.select(gates.text_layer_gate(F.col("t"))["reason"].alias("r")), "r") == ["empty", "script", "ok", "single_characters", "few_letters", "empty"]


def test_backends_and_engine(spark):
    with pytest.raises(ValueError):
        recognition.open_document(b"", "other")
    with pytest.raises(ValueError):
        recognition.profile("other")
    assert isinstance(recognition.available_backends(), list)

    class Echo:
        name = "echo"

        def recognize(self, image):
            if image == b"bad":
                raise RuntimeError
            return [{"text": image.decode(), "x0": 0, "y0": 0, "x1": 9, "y1": 9, "conf": 90.0, "block_num": 1, "par_num": 1, "line_num": 1}]

    pages = spark.createDataFrame([("d", 0, b"hello"), ("d", 1, b"bad")], "doc_id string, page int, image binary")
    words = recognition.recognized(pages, Echo)
    assert values(recognition.failed_pages(words), "page", "detail") == [(1, "error: RuntimeError")]
    assert values(lines.lines(lines.clean_words(words)), "text") == ["hello"]


def test_imaging():
    page = np.full((120, 200), 255, np.uint8)
    for y in range(10, 110, 12):
        page[y : y + 4, 10:190:3] = 0
    assert (imaging.sauvola(page) == 0).sum() > 0
    assert abs(imaging.find_skew(page)) <= 0.5
    ruled = page.copy()
    ruled[5, :] = 0
    assert (imaging.remove_rules(ruled)[5] == 255).all()
    assert len(imaging.components(page == 0)) == 60 * 9


def test_job_queue():
    now = [0.0]
    queue = jobs.JobQueue(capacity=2, ttl=10, clock=lambda: now[0])
    a, b = queue.submit("a"), queue.submit("b")
    with pytest.raises(jobs.QueueFull):
        queue.submit("c")
    queue.run(a, lambda f: f.upper())
    queue.run(b, lambda f: 1 / 0)
    assert queue.take(a)["result"] == "A" and queue.take(a) is None
    assert queue.summary()["total"] == 1
    now[0] = 11.0
    assert queue.take(b) is None
    c = queue.submit("c")
    assert queue.cancel(c) and queue.take(c) is None


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("500 тенге", encoding="utf-8")
    jobs.run_available(jobs.intake(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).select(F.col("fields.amounts")[0]["value"].alias("v")).first().v == "500"
