"""Body of a page: its text less what stands before the first and after the last block of prose."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words and endings of finite verbs.
FUNCTION_WORDS = frozenset(
    """
    ve veya ya da ile ama ancak fakat lakin çünkü eğer ki ise de da
    bir bu şu o bunu bunun buna bunlar şunu onun ona onu onlar onlara
    ben sen biz siz kendi kendisi kendini
    için gibi kadar sonra önce göre üzere karşı rağmen dolayı beri doğru
    daha çok az en hem bile yine artık zaten sadece ayrıca henüz hâlâ hala
    var yok değil olan olarak oldu olduğu olduğunu olmak olur olsa oluyor
    ne nasıl neden niçin hangi kim nerede niye
    her bazı birçok tüm bütün hiç herhangi birkaç
    şey şekilde durumda halde yerine arasında içinde üzerinde altında yanında
    ediyor etti etmek eden edilen yapılan yapılır yaptı diye dedi demek
    böyle şöyle işte oysa yoksa iken dahi
    """.split()
)
VERB = re.compile(r"(?:(?:m[ıiuü]ş|d[ıiuü]|t[ıiuü])(?:t[ıiuü]r|d[ıiuü]r|lar|ler|m|n|k|nız|niz|nuz|nüz)?|[ıiuü]yor(?:du|muş|lar|ler)?|(?:a|e)ca[kğ][ıi]?(?:t[ıiuü]r|lar|ler)?|(?:a|e)ce[kğ][ıi]?(?:t[ıiuü]r|lar|ler)?|m(?:a|e)kt(?:a|e)d[ıiuü]r|[ıiuü]l(?:m[ıiuü]ş|d[ıiuü])|d[ıiuü]r|t[ıiuü]r)$")
#: Words of a block, least words of a page that is trimmed, shares in a hundred words of a prose block, and in a page what may go at either end and must stay.
BLOCK, LEAST_WORDS, FUNCTION_SHARE, VERB_SHARE = 24, 120, 12, 8
MOST_TRIM, LEAST_KEPT = 2, 4  # at most a half goes at an end, at least a quarter stays
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
STOP = re.compile(r"[.!?…](?=\s)")


def fold(text: str) -> str:
    """Small letters with i and ı apart, of the same length as the text."""
    low = text.replace("I", "ı").replace("İ", "i")
    small = low.lower()
    return small if len(small) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in low)


def prose_blocks(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(start, end, is prose) of each block of words, and the number of words."""
    spans = np.array([m.span() for m in WORD.finditer(text)], dtype=np.int64).reshape(-1, 2)
    n = len(spans)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), 0
    low = fold(text)
    words = [low[a:b] for a, b in spans.tolist()]
    first = np.arange(0, n, BLOCK)
    size = np.diff(np.r_[first, n])
    start, end = spans[first, 0], spans[first + size - 1, 1]
    total = lambda flags: np.add.reduceat(np.fromiter(flags, np.int64, n), first)
    function, verbs = total(w in FUNCTION_WORDS for w in words), total(VERB.search(w) is not None for w in words)
    stops = np.array([m.start() for m in STOP.finditer(text)], dtype=np.int64)
    ends = np.searchsorted(stops, end) - np.searchsorted(stops, start)
    dense = function * 100 >= size * FUNCTION_SHARE
    formal = (function * 200 >= size * FUNCTION_SHARE) & (verbs * 100 >= size * VERB_SHARE) & (ends >= 1)
    return start, end, dense | formal, n


def body_span(text: str) -> tuple[int, int]:
    """Where the body starts and ends; the whole text where it is short, has no prose, or too much would go."""
    start, end, prose, words = prose_blocks(text)
    told = np.flatnonzero(prose)
    size = len(text)
    if words < LEAST_WORDS or len(start) < 3 or not len(told):
        return 0, size
    a, b = int(start[told[0]]), int(end[told[-1]])
    a = 0 if a * MOST_TRIM > size else a
    b = size if (size - b) * MOST_TRIM > size else b
    return (a, b) if (b - a) * LEAST_KEPT >= size else (0, size)


def body_of(text: str | None) -> str | None:
    if text is None:
        return None
    a, b = body_span(text)
    return text[a:b]


def body(text: Column) -> Column:
    """The body as a contiguous part of the text; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(body_of)

    return run(text)
