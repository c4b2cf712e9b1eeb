"""Recognition plug-ins: the engine protocol, PDF backends, and how they run inside tasks.

No engine is bundled. An engine is made once in each Python worker and fed page by
page; poppler tools and MuPDF are used where they are installed.
"""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..schemas import WORDS


@dataclass(frozen=True)
class PipelineProfile:
    """Options of a recognition run."""

    engines: tuple[str, ...] = ("tesseract",)
    tessdata: str = "best"
    lang: str = "rus+kaz"
    psm: int = 6
    orientation: bool = True
    deskew: bool = True
    denoise: bool = True
    digit_pass: bool = True
    base_dpi: int = 300
    adaptive_dpi: bool = True
    paddle_limit: int = 2000


#: The named profiles; "finetuned" stands for a model of one's own.
PROFILES: dict[str, PipelineProfile] = {
    "fast": PipelineProfile(tessdata="fast", orientation=False, deskew=False, denoise=False, digit_pass=False, base_dpi=250),
    "balanced": PipelineProfile(tessdata="fast"),
    "accurate": PipelineProfile(tessdata="fast", base_dpi=400),
    "ft-balanced": PipelineProfile(lang="finetuned"),
    "ft-accurate": PipelineProfile(lang="finetuned", psm=4, base_dpi=400),
}


def profile(name: str) -> PipelineProfile:
    """A profile by name; ValueError if there is none. New ones are added to ``PROFILES``."""
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; there are {', '.join(sorted(PROFILES))}")
    return PROFILES[name]


class Engine(Protocol):
    """What recognises a page: rows of the words table (without doc_id and page)."""

    name: str

    def recognize(self, image: bytes) -> list[dict]: ...


class PdfDocument(Protocol):
    """An open PDF."""

    def page_count(self) -> int: ...
    def page_text(self, page: int) -> str: ...
    def rasterize(self, page: int, dpi: int) -> bytes: ...


class InvalidPdf(Exception):
    """A file that no backend can read as a PDF."""


class PopplerDocument:
    """A PDF read by the poppler command line tools."""

    def __init__(self, content: bytes):
        self._file = tempfile.NamedTemporaryFile(suffix=".pdf")  # noqa: SIM115  lives as long as the document
        self._file.write(content)
        self._file.flush()
        self.report = self._run("pdfinfo", self._file.name).decode(errors="replace")
        self._pages: list[str] | None = None

    @staticmethod
    def _run(*command: str) -> bytes:
        done = subprocess.run(command, capture_output=True, timeout=120)
        if done.returncode:
            raise InvalidPdf(done.stderr.decode(errors="replace")[:200])
        return done.stdout

    def page_count(self) -> int:
        found = re.search(r"^Pages:\s+(\d+)", self.report, re.MULTILINE)
        return int(found[1]) if found else 0

    def page_text(self, page: int) -> str:
        if self._pages is None:
            self._pages = self._run("pdftotext", "-layout", self._file.name, "-").decode(errors="replace").split("\f")
        return self._pages[page] if page < len(self._pages) else ""

    def rasterize(self, page: int, dpi: int) -> bytes:
        return self._run("pdftoppm", "-gray", "-r", str(dpi), "-f", str(page + 1), "-l", str(page + 1), self._file.name)


class MuPdfDocument:
    """A PDF read by PyMuPDF."""

    def __init__(self, content: bytes):
        import fitz

        try:
            self._doc = fitz.open(stream=content, filetype="pdf")
        except Exception as error:
            raise InvalidPdf(str(error)) from error

    def page_count(self) -> int:
        return self._doc.page_count

    def page_text(self, page: int) -> str:
        return self._doc[page].get_text()

    def rasterize(self, page: int, dpi: int) -> bytes:
        return self._doc[page].get_pixmap(dpi=dpi, colorspace="gray").tobytes("ppm")


def available_backends() -> list[str]:
    """Backends that this machine has the programs or modules of."""
    found = ["poppler"] if shutil.which("pdfinfo") and shutil.which("pdftotext") else []
    try:
        import fitz  # noqa: F401

        found.append("pymupdf")
    except ImportError:
        pass
    return found


def open_document(content: bytes, backend: str | None = None) -> PdfDocument:
    """An open PDF by the backend asked for, named in QUILLSTONE_PDF_BACKEND, or poppler."""
    name = backend or os.environ.get("QUILLSTONE_PDF_BACKEND") or "poppler"
    kinds = {"poppler": PopplerDocument, "pymupdf": MuPdfDocument}
    if name not in kinds:
        raise ValueError(f"unknown backend {name!r}")
    return kinds[name](content)


def recognized(pages: DataFrame, make_engine: Callable[[], Engine]) -> DataFrame:
    """The words table from pages (doc_id, page, image).

    A page that raises gives one row with null text and the error as engine, so
    others go on; ``failed_pages`` finds these. Batches are small because images are large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in WORDS.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in WORDS.split(", ")])
        engine = None
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    engine = engine or make_engine()
                    found = [dict.fromkeys(names) | w | {"seq": i, "engine": engine.name} for i, w in enumerate(engine.recognize(row["image"]))]
                except Exception as error:  # a bad page must not lose the document
                    found = [dict.fromkeys(names) | {"engine": f"error: {type(error).__name__}"}]
                for w in found:
                    w |= {"doc_id": row["doc_id"], "page": row["page"]}
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    return pages.select("doc_id", "page", "image").mapInArrow(run, WORDS)


def failed_pages(words: DataFrame) -> DataFrame:
    """Warnings of pages that the engine failed on."""
    from pyspark.sql import functions as F

    bad = words.filter("text is null and engine like 'error: %'")
    return bad.select("doc_id", "page", F.lit("page_failed").alias("type"), F.col("engine").alias("detail"))
