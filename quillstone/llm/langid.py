"""Language identification: family first, then one-versus-one linear SVMs within it.

Features are hashed letter n-grams (1 to 4 letters of lower-cased words with
their edges), weighted by square roots of their shares of a text. A linear
family model (one SVM for each family against the rest) picks the family;
within it every pair of languages has its own linear SVM, and votes decide.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Families of languages by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
    "baltic": ("lt", "lv"),
}
BITS = 15
PIECE_CHARS = 1 << 20

UND = "und"


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"only {lang}")


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; what isn't a letter is a space; a space also stands at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters(codes), codes, 32).astype(np.uint32)


_LETTER = np.zeros(0x110000, bool)


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _LETTER.any():
        _LETTER[:] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER[codes]


def _grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For n = 1 to 4: the hashed n-gram that ends at each character (the first n - 1 wrap round)."""
    key = np.zeros(len(codes), np.uint32)
    shifted = codes
    for n in range(1, 5):
        key = key * np.uint32(0x9E3779B1) + (shifted + np.uint32(n)) * np.uint32(0x85EBCA6B)
        yield ((key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
        shifted = np.concatenate([codes[:n], codes[:-n]]) if len(codes) > n else codes


Row = tuple[np.ndarray, np.ndarray]


def features(text: str) -> Row | None:
    """Numbers of a whole text's n-grams and roots of their counts, to length 1; None without
    a letter. A long text is taken in pieces whose counts are added, so memory stays bounded."""
    counts, letters = np.zeros(1 << BITS, np.int32), False
    for at in range(0, len(text), PIECE_CHARS):
        codes = _codes(text[at : at + PIECE_CHARS])
        letters = letters or bool((codes != 32).any())
        for g in _grams(codes):
            counts += np.bincount(g, minlength=1 << BITS).astype(np.int32)
    if not letters:
        return None
    hit = np.flatnonzero(counts)
    root = np.sqrt(counts[hit].astype(np.float32))
    return hit.astype(np.int32), root / np.linalg.norm(root)


def linear_svm(rows: list[Row], y: np.ndarray, c: float = 4.0, epochs: int = 12, seed: int = 1) -> np.ndarray:
    """Weights of an L2-regularised squared-hinge linear SVM (dual coordinate descent on sparse rows); the last is the bias."""
    w, alpha = np.zeros((1 << BITS) + 1, np.float32), np.zeros(len(rows))
    norm, order = 2.0 + 0.5 / c, np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            hit, value = rows[i]
            g = y[i] * float(w[hit] @ value + w[-1]) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - g / norm)
            if new != alpha[i]:
                step = np.float32((new - alpha[i]) * y[i])
                w[hit] += step * value
                w[-1] += step
                alpha[i] = new
    return w


@dataclass
class LanguageModel:
    """Families and languages, and one column of ``weights`` for each SVM."""

    langs: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # (2**BITS + 1, families + pairs); the last row is the bias
    scale: list[float] = field(default_factory=list)

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        """Language and score from the margins of all SVMs of one text."""
        sure = 1 / (1 + np.exp(-np.clip(margins * self.scale, -50, 50)))
        n = len(self.families)
        at = int(np.argmax(margins[:n])) if n else 0
        own = [x for x in self.langs if family_of(x) == self.families[at]]
        score = float(sure[at]) if n > 1 else 1.0
        votes, belief = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
        for k, (a, b) in enumerate(self.pairs):
            if a in votes and b in votes:
                p = float(sure[n + k])
                votes[a if p >= 0.5 else b] += 1
                belief[a] += p
                belief[b] += 1 - p
        best = max(own, key=lambda x: (votes[x], belief[x]))
        return best, score * (belief[best] / (len(own) - 1) if len(own) > 1 else 1.0)


def train(texts: list[str], langs: list[str]) -> LanguageModel:
    """Fit family and pair SVMs on labelled texts (texts without letters don't count)."""
    kept = [(row, lang) for row, lang in ((features(t), x) for t, x in zip(texts, langs, strict=True)) if row is not None]
    names = sorted({lang for _, lang in kept})
    families = sorted({family_of(v) for v in names})
    pairs = [(a, b) for a, b in itertools.combinations(names, 2) if family_of(a) == family_of(b)]
    rows, of = [row for row, _ in kept], [family_of(lang) for _, lang in kept]
    columns = [linear_svm(rows, np.array([1.0 if x == f else -1.0 for x in of])) if len(families) > 1 else np.zeros((1 << BITS) + 1, np.float32) for f in families]
    for a, b in pairs:
        two = [(row, 1.0 if lang == a else -1.0) for row, lang in kept if lang in (a, b)]
        columns.append(linear_svm([row for row, _ in two], np.array([v for _, v in two])))
    weights = np.stack(columns, axis=1) if columns else np.zeros(((1 << BITS) + 1, 0), np.float32)
    return LanguageModel(names, families, pairs, weights.astype(np.float32), [6.0] * weights.shape[1])


def predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of whole texts: ``und`` and 0 where there is no letter."""
    langs, scores = [], []
    for t in texts:
        row = features(t or "") if model.langs else None
        lang, score = (UND, 0.0) if row is None else model.decide(row[1] @ model.weights[row[0]] + model.weights[-1])
        langs.append(lang)
        scores.append(score)
    return langs, scores


def fit(labelled: DataFrame, per_language: int = 400, max_chars: int = 200_000, max_languages: int = 1000) -> LanguageModel:
    """Fit on a bounded sample of ``labelled`` (doc_id, text, lang): about ``per_language``
    whole texts of each language, those with the lowest hashes. Null text or lang is left out,
    texts of over ``max_chars`` aren't learned from; ValueError beyond ``max_languages``."""
    rows = labelled.filter((F.length("text") <= max_chars) & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("at"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    if not counts:
        return LanguageModel([], [], [], np.zeros(((1 << BITS) + 1, 0), np.float32))
    chosen = F.lit(False)
    for lang, n in counts.items():  # shares of the hash range, a little over what is needed
        share = min(1.0, (per_language + 6 * math.sqrt(per_language)) / n)
        chosen = chosen | ((F.col("lang") == lang) & (F.col("at") <= int(-(2**63) + share * (2**64 - 1025))))
    sample: dict[str, list] = {}
    for r in rows.filter(chosen).select("lang", "text", "at").collect():
        sample.setdefault(r.lang, []).append((r["at"], r.text))
    texts, langs = [], []
    for lang in sorted(sample):
        for _, t in sorted(sample[lang])[:per_language]:
            texts.append(t)
            langs.append(lang)
    return train(texts, langs)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (with text) and two more columns: lang_pred, score (0 to 1).

    A null text or one without a letter is ``und`` with score 0. Texts are read
    whole. Any other columns pass through; the names lang_pred and score replace
    columns of these names. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        langs, scores = predict(held.value, [None if pd.isna(t) else t for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    docs = docs.drop("lang_pred", "score")
    (both,) = fresh(docs.columns, "guess")
    return docs.withColumn(both, guess("text")).select("*", f"{both}.lang_pred", f"{both}.score").drop(both)


def held_out(doc_id: Column) -> Column:
    """The fold that isn't learned from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
