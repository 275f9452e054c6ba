"""Character trigram models per language, counted over all rows of a table.

The alphabet has 64 codes, so a language has at most 64**3 trigrams; the
counts that reach the driver are bounded by that, not by the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyzçğıöşüäßéèêëàâîïôûùœæ"
BASE = 64
SIZE = BASE**3
LANGUAGES = ("tr", "en", "de", "fr")

_CODE = np.zeros(0x110000, dtype=np.int32)
for _i, _ch in enumerate(LETTERS):
    _CODE[ord(_ch)] = _i + 1
    if len(_ch.upper()) == 1:
        _CODE[ord(_ch.upper())] = _i + 1
_CODE[ord("İ")] = _CODE[ord("I")] = _CODE[ord("i")]


def codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def trigrams(text: str) -> np.ndarray:
    """Codes of all trigrams of a text, a boundary added at each end.

    Trigrams with a boundary in the middle, or with two, say little and are left out.
    """
    c = np.concatenate(([0], codes(text), [0]))
    made = (c[:-2] * BASE + c[1:-1]) * BASE + c[2:]
    return made[(c[1:-1] > 0) & ((c[:-2] > 0) | (c[2:] > 0))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang and text:
                by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            total.setdefault(lang, np.zeros(SIZE, dtype=np.int64))
            total[lang] += np.bincount(trigrams("\n".join(texts)), minlength=SIZE)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "tri", "n"])


def fit(texts: DataFrame, lang_col: str, text_col: str) -> np.ndarray:
    """log P(trigram | language) as one row per language of LANGUAGES.

    Wrong labels only blur the counts; unknown labels are not used.
    """
    primary = F.lower(F.regexp_extract(F.trim(F.col(lang_col)), r"^([A-Za-z]+)", 1))
    rows = (
        texts.select(primary.alias("lang"), F.col(text_col).alias("text"))
        .where(F.col("lang").isin(*LANGUAGES))
        .mapInArrow(_count, "lang string, tri long, n long")
        .groupBy("lang", "tri")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    counts = np.zeros((len(LANGUAGES), SIZE))
    for i, lang in enumerate(LANGUAGES):
        own = rows[rows["lang"] == lang]
        counts[i, own["tri"].to_numpy(dtype=np.int64)] = own["n"].to_numpy()
    return counts


def log_joint(counts: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    """log P(trigram | language), smoothed, for naive Bayes."""
    seen = max(int((counts > 0).any(axis=0).sum()), 1)
    return np.log((counts + alpha) / (counts.sum(axis=1, keepdims=True) + alpha * seen)).astype(np.float32)


def log_next(counts: np.ndarray, alpha: float = 0.1) -> np.ndarray:
    """log P(third character | first two) of one language's counts."""
    grid = counts.reshape(BASE * BASE, BASE)
    return np.log((grid + alpha) / (grid.sum(axis=1, keepdims=True) + alpha * BASE)).astype(np.float32).reshape(-1)
