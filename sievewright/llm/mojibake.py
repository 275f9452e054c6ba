"""Problem 9: text decoded with the wrong character encoding.

Every white-space token with suspicious characters goes through a best-first
search: a state is a string, an edge encodes its non-ASCII runs under one code
page and decodes the bytes as UTF-8 or as the Turkish code page, or unescapes
HTML entities; visited strings are hashed, and the cheapest string by a
character-plausibility cost is expanded first. The cheapest reachable string
is the repair. Equal tokens are searched once a worker.

A repair through UTF-8 stands by itself, as chance text is hardly ever valid.
A repair through the Turkish code page (ý, þ, ð for ı, ş, ğ) must also be
likelier than its rivals under a Turkish character-trigram model counted over
all documents. Replacement characters beside letters are damage that can't be
undone. A sequence that stands alone in a sentence, quoted or named as a sign,
is an example and no damage.

Defined results: null, empty and blank texts are not affected; texts are
processed whole, line by line, at any length; unexpected extra columns are
ignored; repeated rows give repeated repairs and one distinct id.
"""

from __future__ import annotations

import functools
import heapq
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievewright.llm import ngram
from sievewright.tables import spread

WRONG = ("cp1252", "latin-1", "cp1254", "cp1250", "cp1251", "cp1253", "mac_roman", "mac_turkish", "cp437", "cp850", "cp857", "iso8859-9", "iso8859-2")
LEGACY = ("latin-1", "cp1252", "cp1250", "cp1251", "cp857")
EXPECTED = frozenset("çğıöşüÇĞİÖŞÜäßÄéèêëàâîïôûùœæÉÈÊËÀÂÎÏÔÛÙŒ")
TYPOGRAPHIC = frozenset("’‘“”„‚‹›«»–—…•©®°€§ ")
RUN = re.compile(r"[^\x00-\x7f]+")
ENTITY = re.compile(r"&(?:#\d+|#[xX][\da-fA-F]+|[a-zA-Z][a-zA-Z\d]*);")
VALID = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
QUOTES = "“”„‘’\"'«»‹›()[]`"


def cost(s: str) -> float:
    """Implausibility of a string's characters."""
    total = 0.5 * len(ENTITY.findall(s)) if "&" in s else 0.0
    for ch in s:
        if ch < "\x80":
            continue
        if ch in EXPECTED or ch in TYPOGRAPHIC:
            total += 0.1
        elif ch == "�" or "\x80" <= ch <= "\x9f":
            total += 3
        elif not ch.isalpha():
            total += 1.2
        else:
            total += 0.6 if ch < "\u0250" else 1.5
    return total


@functools.cache
def _bytes_of(codec: str) -> dict[str, int]:
    """Character -> byte; bytes that a code page leaves undefined pass as control characters."""
    table = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


def _as_utf8(run: str, codec: str) -> str:
    """The run's bytes read as UTF-8; of a damaged run only its valid sequences."""
    table = _bytes_of(codec)
    raw = [table.get(ch) for ch in run]
    if None not in raw:
        try:
            return bytes(raw).decode("utf-8")
        except UnicodeDecodeError:
            pass
    data = bytes(0 if b is None else b for b in raw)
    if not VALID.search(data):
        return run
    out, at = [], 0
    for m in VALID.finditer(data):
        try:
            piece = m[0].decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [run[at : m.start()], piece]
        at = m.end()
    return "".join(out) + run[at:]


def _legacy(run: str, table: dict[str, int]) -> str:
    raw = [table.get(ch) for ch in run]
    if None in raw:
        return run
    try:
        return bytes(raw).decode("cp1254")
    except UnicodeDecodeError:
        return run


def edges(s: str, first: bool) -> Iterator[tuple[str, str]]:
    """(operation, next string); the Turkish code page is tried on the text as found only."""
    for codec in WRONG:
        yield f"{codec}>utf-8", RUN.sub(lambda m, c=codec: _as_utf8(m[0], c), s)
    for codec in LEGACY if first else ():
        yield f"{codec}>cp1254", RUN.sub(lambda m, c=codec: _legacy(m[0], _bytes_of(c)), s)
    if "&" in s:
        yield "unescape", html.unescape(s)


def search(s: str) -> tuple[str, tuple[str, ...]]:
    """Cheapest reachable string and the operations that lead to it.

    Every step but the first shortens the string, so the search ends by itself.
    """
    best, path = (cost(s), 0), ()
    found, heap, seen = s, [(best[0], 0, s, ())], {s}
    while heap:
        c, depth, now, ops = heapq.heappop(heap)
        if (c, depth) < best:
            best, found, path = (c, depth), now, ops
        if now.isascii() and "&" not in now:
            continue
        for op, after in edges(now, depth == 0):
            if after not in seen:
                seen.add(after)
                heapq.heappush(heap, (cost(after), depth + 1, after, (*ops, op)))
    return found, path


#: A token is searched if two foreign characters meet or one is not of the languages' own.
SUSPICIOUS = re.compile("[^\x00-\x7f]{2}|[^\x00-\x7f" + "".join(sorted(EXPECTED | TYPOGRAPHIC)) + "]|&[#a-zA-Z]")
TOKEN = re.compile(r"[^ \t\r\n]+")
LOST = re.compile(r"(?<=[^\W\d_])�|�(?=[^\W\d_])")
#: Least mean log-likelihood of a character, by letters of the longest word; shorter words prove nothing.
LIKELY = {4: -2.4, 5: -3.2}
TURKISH = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZçğıöşüÇĞİÖŞÜâîûÂÎÛ")
LEGACY_MARKS = re.compile("[ýþðÝÞÐ]")


class Repairer:
    """Repairs lines; keeps what it found for each token."""

    def __init__(self, turkish: np.ndarray):
        self.turkish = turkish
        self.known: dict[str, tuple[str, str]] = {}

    def likelihood(self, word: str) -> float:
        c = np.concatenate(([0], ngram.codes(word), [0]))
        if len(c) < 4:
            return -99.0
        return float(self.turkish[(c[:-2] * ngram.BASE + c[1:-1]) * ngram.BASE + c[2:]].mean())

    def token(self, s: str) -> tuple[str, str]:
        """(repair, kind): kind is '', 'utf8' or 'legacy'."""
        if (got := self.known.get(s)) is not None:
            return got
        fixed, path = search(s)
        kind = ""
        if any(op.endswith("utf-8") for op in path):
            kind = "utf8"
        elif any(op.endswith("cp1254") for op in path):
            kind = "legacy" if self._is_turkish(s, fixed) else ""
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[s] = (fixed, kind) if kind else (s, "")
        return self.known[s]

    def _is_turkish(self, s: str, fixed: str) -> bool:
        if "Ã" in s and EXPECTED.issuperset("".join(RUN.findall(s)).replace("Ã", "")):  # as well half a UTF-8 letter whose rest is lost
            return False
        words = [w for w in re.findall(r"[^\W\d_]+", fixed) if not w.isascii()]
        least = LIKELY.get(min(max(map(len, words), default=0), 5))
        return least is not None and all(TURKISH.issuperset(w) for w in words) and min(map(self.likelihood, words)) > least

    def line(self, line: str) -> tuple[str, bool]:
        """(repaired line, affected)."""
        lost = bool(LOST.search(line))
        if not SUSPICIOUS.search(line):
            return line, lost
        hits, alone, spans = 0, 0, []
        tokens = 0
        for m in TOKEN.finditer(line):
            tokens += 1
            if SUSPICIOUS.search(m[0]):
                fixed, kind = self.token(m[0])
                if kind:
                    hits += 1
                    spans.append((m.start(), m.end(), fixed))
                    alone += kind == "utf8" and self._is_example(html.unescape(m[0]), fixed, tokens == 1)
        if not hits or alone == hits:
            return line, lost
        if LEGACY_MARKS.search(line):  # the short words of a line that is affected anyway
            have = {a for a, _, _ in spans}
            for m in TOKEN.finditer(line):
                if m.start() not in have and LEGACY_MARKS.search(m[0]):
                    fixed = RUN.sub(lambda r: _legacy(r[0], _bytes_of("latin-1")), m[0])
                    if all(TURKISH.issuperset(w) for w in re.findall(r"[^\W\d_]+", fixed)):
                        spans.append((m.start(), m.end(), fixed))
            spans.sort()
        out, at = [], 0
        for a, b, fixed in spans:
            out += [line[at:a], fixed]
            at = b
        return "".join(out) + line[at:], True

    @staticmethod
    def _is_example(token: str, fixed: str, first: bool) -> bool:
        core, plain = token.strip(QUOTES + ".,;:!?"), fixed.strip(QUOTES + ".,;:!?")
        quoted = token[:1] in QUOTES and token[-1:] in QUOTES + ".,;:!?"
        if re.search(r"[A-Za-z0-9]", token):
            return False
        if quoted and len(token) > len(core):
            return True
        return not first and len(plain) <= 2 and not (plain in ("à", "É") or (fixed and fixed[0] in "–—•©«»…®“”„"))

    def text(self, text: str) -> tuple[str, bool]:
        lines, any_bad = [], False
        for line in text.split("\n"):
            fixed, bad = self.line(line)
            lines.append(fixed)
            any_bad |= bad
        return ("\n".join(lines), True) if any_bad else (text, False)


def repairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, repaired, restored) of each affected text.

    restored is false where replacement characters remain.
    """
    turkish = ngram.log_next(ngram.fit(docs, lang_col, text_col)[ngram.LANGUAGES.index("tr")])
    shared = docs.sparkSession.sparkContext.broadcast(turkish)  # 1 MB at any input size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(shared.value)
        for batch in batches:
            ids, out, whole = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None or (text.isascii() and "&" not in text):
                    continue
                fixed, bad = repairer.text(text)
                if bad:
                    ids.append(i)
                    out.append(fixed)
                    whole.append(LOST.search(fixed) is None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array(whole, pa.bool_())], names=["doc_id", "repaired", "restored"])

    rows = docs.select(docs[id_col].cast("long"), docs[text_col].cast("string"))
    return spread(rows).mapInArrow(run, "doc_id long, repaired string, restored boolean")


def affected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Distinct ids of affected texts."""
    return repairs(docs, id_col, text_col, lang_col).select("doc_id").where("doc_id is not null").distinct()
