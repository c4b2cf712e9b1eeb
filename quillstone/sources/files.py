"""File sources: PDF folders, ground truth, predictions, sidecars, engine output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.gates import MAX_BYTES, MAX_PAGES
from ..schemas import FIELD_KEYS


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def pdf_folder(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, path, length, content) of the folder's PDF files up to the size limit, which is
    judged from metadata before any content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).filter(F.col("length") <= max_bytes)
    return files.select(F.regexp_replace(_name(F.col("path")), r"\.pdf\z", "").alias("doc_id"), "path", "length", "content")


def within_pages(docs: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Documents with at most the allowed number of pages (n_pages)."""
    return docs.filter(F.col("n_pages") <= max_pages)


def page_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, page, raw_text): a document's text layer (text) cut at form feeds; what follows the last is no page."""
    pages = F.split(F.regexp_replace("text", "\f\\z", ""), "\f")
    return docs.select("doc_id", F.posexplode(pages).alias("page", "raw_text"))


def image_coverage(images: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, coverage): the largest share of a page under one image (width, height, dpi of each)."""
    area = (F.col("width") / F.col("x_dpi") * 72.0) * (F.col("height") / F.col("y_dpi") * 72.0)
    rows = pages.join(images.filter("x_dpi > 0 and y_dpi > 0").select("doc_id", "page", area.alias("area")), ["doc_id", "page"], "left")
    share = F.max(F.coalesce("area", F.lit(0.0)) / (F.col("width_pt") * F.col("height_pt")))
    return rows.groupBy("doc_id", "page").agg(F.least(F.lit(1.0), share).alias("coverage"))


def page_info(reports: DataFrame) -> DataFrame:
    """(doc_id, n_pages, width_pt, height_pt) from ``pdfinfo`` reports (report); 595 × 842 where there is no size."""

    def number(pattern: str, group: int, kind: str) -> Column:
        return F.regexp_extract("report", pattern, group).try_cast(kind)

    size = r"(?m)^Page(?:\s+\d+)? size:\s+([0-9.]+) x ([0-9.]+)"
    return reports.select(
        "doc_id", number(r"(?m)^Pages:\s+(\d+)", 1, "int").alias("n_pages"),
        F.coalesce(number(size, 1, "double"), F.lit(595.0)).alias("width_pt"), F.coalesce(number(size, 2, "double"), F.lit(842.0)).alias("height_pt"),
    )


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the folder's text files."""
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(path)
    return texts.select(F.regexp_replace(_name(F.input_file_name()), r"\.txt\z", "").alias("name"), F.col("value").alias("text"))


def first_predictions(files: DataFrame) -> DataFrame:
    """(name, text) from (file, text): ``a.pdf.txt`` and ``a.txt`` are both ``a``; the first file in order counts."""
    named = files.withColumn("name", F.regexp_replace("file", r"(?:\.pdf)?\.txt\z", ""))
    order = Window.partitionBy("name").orderBy("file")
    return named.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("name", "text")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of a folder of predictions."""
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(path)
    return first_predictions(texts.select(_name(F.input_file_name()).alias("file"), F.col("value").alias("text")))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(name, field, value) of the folder's ``<name>.fields.json`` files."""
    schema = ", ".join(f"{k} array<string>" for k in FIELD_KEYS)
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.fields.json").json(path)
    rows = rows.withColumn("name", F.regexp_replace(_name(F.input_file_name()), r"\.fields\.json\z", ""))
    pairs = F.create_map(*(x for k in FIELD_KEYS for x in (F.lit(k), F.col(k))))
    return rows.select("name", F.explode(pairs).alias("field", "values")).select("name", "field", F.explode("values").alias("value"))


def engine_words(pages: DataFrame) -> DataFrame:
    """Words from parallel arrays of an engine's report (text, conf, block_num, par_num, line_num, left, top, width, height)."""
    arrays = ("text", "conf", "block_num", "par_num", "line_num", "left", "top", "width", "height")
    rows = pages.select("doc_id", "page", "engine", F.posexplode(F.arrays_zip(*arrays)).alias("seq", "w"))
    x, y = F.col("w.left"), F.col("w.top")
    return rows.select("doc_id", "page", "w.block_num", "w.par_num", "w.line_num", "seq", "w.text", x.alias("x0"), y.alias("y0"), (x + F.col("w.width")).alias("x1"), (y + F.col("w.height")).alias("y1"), "w.conf", "engine")


def detector_words(pages: DataFrame) -> DataFrame:
    """Words, one a line, from a detector's texts, scores, boxes and polygons; a box counts before its polygon, without either the text goes."""
    rows = pages.select("doc_id", "page", "engine", F.posexplode("rec_texts").alias("seq", "text"), "rec_scores", "rec_boxes", "rec_polys")
    i = F.col("seq")
    box, polygon = F.get("rec_boxes", i), F.get("rec_polys", i)

    def side(at: int, axis: int, pick) -> Column:
        return F.coalesce(F.get(box, F.lit(at)).cast("int"), pick(F.transform(polygon, lambda p: F.get(p, F.lit(axis)))).cast("int"))

    conf = F.coalesce(F.get("rec_scores", i), F.lit(0.0)).cast("double")
    words = rows.select(
        "doc_id", "page", F.lit(0).alias("block_num"), F.lit(0).alias("par_num"), i.alias("line_num"), "seq",
        F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "").alias("text"),
        side(0, 0, F.array_min).alias("x0"), side(1, 1, F.array_min).alias("y0"), side(2, 0, F.array_max).alias("x1"), side(3, 1, F.array_max).alias("y1"),
        conf.alias("conf"), "engine",
    )
    return words.filter("text <> '' and x0 is not null")
