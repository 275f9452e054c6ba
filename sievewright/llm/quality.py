"""Problem 1: per-document text statistics and structural kind.

Each text is cut into segments at blank lines and where the shape of its lines
changes. A segment is described by three distributions: character classes in
their context (letters, digits, blanks, line ends, punctuation, separators,
symbols), words (function words by language, articles, new and repeated
content words, numbers, words that can't be spoken) and, as the basic counts,
characters by form of line. Its Jensen-Shannon divergence from structural
profiles (prose of four languages, forms of list, table and junk) gives the
nearest one, and the kind with most characters is the text's kind.

The profiles are counted over the whole corpus: short exemplars written here
seed them, each round gives every segment to its nearest profile and counts
the profiles anew over all segments. Only the profiles' sums, a few dozen
short rows at any input size, reach the driver.

All counts of a batch are made in numpy over one array of code points.

Defined results: null, empty and blank texts have zero counts, null ratios and
kind null; whole texts are read at any length; redelivered revisions give one
row; a null revision id is kept in the statistics and never in p1_found; equal
divergences or masses take the kind named first in KINDS.
"""

from __future__ import annotations

import functools
import textwrap
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.tables import spread, written

FUNCTION_WORDS = {
    "tr": frozenset("ve ile bir bu için en çok daha ama ancak her kadar ise gibi olarak de da ne ya hem yoksa mı mi mu mü değil olan sonra önce göre eğer yine aynı iyi kimi diye şu o ki çünkü hiç bile arasında bunun".split()),
    "en": frozenset("the a an of and or to in is are was were that which who with for by on as at from it its be been has have had not no but than then if when while this these they we she he because nor neither about more some every".split()),
    "de": frozenset("der die das den dem des ein eine einen einem einer und oder zu in im ist sind war waren mit von für auf aus als bei nach nicht noch auch aber weil obwohl dass wenn man es sie er wie so um am an sich nur über ob danach etwa seit".split()),
    "fr": frozenset("le la les l un une des de du d et ou à au aux en est sont était dans par pour sur que qu qui ne n pas plus ce cette c il elle on se s y comme mais avec parce même si très bien entre puis sans ni où dit car".split()),
}
#: Articles alone don't make a sentence of a list of nouns.
ARTICLES = frozenset("the a an der die das den dem des ein eine le la les l un une du d".split())

#: Character types of single code points.
OTHER, VOWEL, CONSONANT, UPPER_VOWEL, UPPER, LETTER, DIGIT, SPACE, NEWLINE, TAB, STOP, COMMA, SEMICOLON, COLON, APOSTROPHE, QUOTE, BRACKET, DASH, BULLET, PIPE, EQUALS, SLASH, PERCENT = range(23)
_MARKS = {STOP: ".!?…", COMMA: ",", SEMICOLON: ";", COLON: ":", APOSTROPHE: "'’", QUOTE: "\"“”„«»‘‹›", BRACKET: "()[]", DASH: "-–—", BULLET: "•*→·▪◦‣+>", PIPE: "|", EQUALS: "=", SLASH: "/\\", PERCENT: "%&"}
_VOWELS = frozenset("aeıioöuüâîûäéèêëàôùœæyáíóúãõå")
PLAIN = frozenset(" \t\r\n.,;:!?'\"()’‘“”„«»-–—…%/&")

#: Classes in context that follow the character types in the counts.
INNER_UPPER, MIXED_DIGIT, SPACE_RUN, LINE_END, SENTENCE_LINE_END, BLANK_LINE, SENTENCE_STOP, NUMBER_MARK, TIGHT_COMMA, LINE_DASH = range(23, 33)
N_CHARS = 33
MASKS = 16  # word classes 0..15: the languages that a function word belongs to, as bits
ARTICLE, NEW_CAPITAL, NEW_LOWER, REPEATED, NUMBER, UNSPEAKABLE, MIXED, SINGLE = range(16, 24)
N_WORDS = 24
ENDED, BULLETED, FIELDED, STRUNG, SHORT, OPEN, SOLID = range(7)  # forms of lines
N_LINES = 7
N = N_CHARS + N_WORDS + N_LINES
PARTS = (slice(0, N_CHARS), slice(N_CHARS, N_CHARS + N_WORDS), slice(N_CHARS + N_WORDS, N))

KINDS = ("prose", "list", "table", "junk")
#: Short texts of each form, from which the first profiles are counted.
EXEMPLARS = {
    ("prose", "tr"): "Bu kitap, eski bir kentin nasıl değiştiğini anlatır ve okura yeni bir bakış kazandırır. Yazar için önemli olan, sokakların sesi kadar insanların sessizliğidir.\nAncak her bölüm aynı hızla ilerlemez; kimi yerde anlatı yavaşlar, kimi yerde de ağırlaşır. Sonra yağmur başladı ve herkes evine döndü.",
    ("prose", "en"): "The town had been quiet for years, and nobody expected that the old mill would open again. It was a cold morning when they saw the smoke.\nSome of the people were glad, but others said that it would not last. She walked to the river because the bridge was closed.",
    ("prose", "de"): "Der alte Hafen war lange leer, und niemand glaubte, dass die Schiffe noch einmal kommen würden. Am Abend ging sie mit dem Hund an das Wasser.\nEr sagte nichts, weil er die Antwort nicht kannte. Die Stadt ist heute größer als früher, aber nicht schöner.",
    ("prose", "fr"): "La maison était vide depuis longtemps, et personne ne croyait que les enfants reviendraient. Il a ouvert la porte et il est entré dans le jardin.\nElle n'a rien dit parce que la réponse était connue. Les gens du village sont partis avec le dernier train.",
    ("list", "bullets"): "- elma\n- kırmızı armut\n- üzüm\n• bread\n• fresh milk\n• das Brot\n* le pain\n* ekmek tabağı\n– der Tisch\n– masa",
    ("list", "numbers"): "1. Elma\n2. Kırmızı armut\n3) Bread\n4) Fresh milk\n5. Das Brot\n(6) Le pain\n(7) Masa\na) Kapı\nb) Pencere\n10. Door\n11. Window",
    ("list", "lines"): "Elma\nKırmızı armut\nBread Milk\nTisch\nBrot Haus\nTable\nPain Maison\nMasa\nKapı Pencere\nDoor\nHaus",
    ("list", "articles"): "L'école Le prix La clé\nLa forêt L'idée\nLe jardin\nDer Garten Die Ordnung\nDas Feld\nDie Regel Der Hafen\nLe port Le registre\nL'écart\nThe door The window\nDas Urteil",
    ("list", "entries"): "- la clé le prix\n- l'école la forêt\n- der Garten die Ordnung\n- das Feld\n1) la règle le port\n2) l'idée\n3. die Regel das Urteil\n• the door the window\n[ ] le jardin l'écart\n[ ] der Hafen",
    ("list", "strung"): "elma, armut, üzüm, kiraz, ceviz, incir\nbread; milk; butter; cheese; door; window\nTisch / Brot / Haus / Garten / Straße\npain · maison · table · porte · jardin",
    ("table", "tabs"): "elma\t1990\t12,50\narmut\t1991\t8,20\nbread\t2003\t140,75\nTisch\t1978\t99,10\npain\t2011\t7,45",
    ("table", "pipes"): "| elma | 1990 | 12,50 |\n|---|---|---|\n| armut | 1991 | 8,20 |\n| bread | 2003 | 140,75 |\n| Tisch | 1978 | 99,10 |",
    ("table", "semicolons"): "elma;1990;12,50;evet\narmut;1991;8,20;hayır\nbread;2003;140,75;yes\nTisch;1978;99,10;-",
    ("table", "quoted"): '"elma","1990","12,50"\n"armut","1991","8,20"\n"bread","2003","140,75"\n"Tisch","1978","99,10"',
    ("table", "columns"): "elma        1990     12,50\narmut       1991     8,20\nbread       2003     140,75\nTisch       1978     99,10",
    ("table", "labels"): "elma: 1200 kg\narmut = 340 adet\nbread : 95 GB\nTisch = 12 mm\npain: 4500 km",
    ("junk", "symbols"): "%$#@!&*<>~^+=?/|\\:;{}%$!@#&*<>~^+=?/|\\:;%$#@!&\n<>~^+=?/|\\:;{}%$!@#&*<>~^+=?/|\\:;%$#@!&*<>~^",
    ("junk", "codes"): "aGVsbG8gd29ybGQ0Rk1pT3BxUnN0VXZXeFl6MTIzNDU2Nzg5MGFiQ0RlRmdISWpLbE1u\nT3BxUnN0VXZXeFl6MTIzNDU2Nzg5MGFiQ0RlRmdISWpLbE1uQUJDREVGR0hJSktMTU5P",
    ("junk", "dump"): "4f 3a 00 ff 12 9c 7e 01 aa bb cc 0d\n00000010 4f3a 00ff 129c 7e01 aabb cc0d\n0x7f3a 0x00ff 0x129c",
    ("junk", "letters"): "xkqw zzrt plmgh wrtk bvncx qwrtp sdfgh\nhjklm nbvcx zxcvb qzwrx tpdfg hjkwq mnbvc",
    ("junk", "repeats"): "elma elma elma elma elma elma elma elma elma elma elma elma\nelma elma elma elma elma elma elma elma elma",
    ("junk", "words"): "elma armut masa kapı bread door window table tisch haus garten pain maison porte jardin yol ağaç deniz river mountain stone glass paper strasse fleur nuit elma masa window haus porte river\nkitap kalem book pencil buch stift livre crayon silgi defter taş toprak hava su earth fire water air stein erde",
}
#: Prose also comes in short lines.
EXEMPLARS |= {(kind, f"{form} in short lines"): "\n".join(textwrap.fill(p, 30) for p in text.split("\n")) for (kind, form), text in EXEMPLARS.items() if kind == "prose"}
OF_KIND = np.array([KINDS.index(kind) for kind, _ in EXEMPLARS])
WEIGHTS = (1, 2, 1)  # of the parts' divergences
ROUNDS = 2  # times the profiles are counted over the corpus
CLEAR = 0.7  # a segment counts for a profile if no other kind is nearer than this share of the other's divergence


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: type, letter or digit, folded code point, symbol."""
    kind, alnum = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
    low = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x34000):
        ch = chr(cp)
        if ch.isspace():
            kind[cp] = SPACE
        elif ch.isalnum():
            alnum[cp] = True
            small = ch.lower()
            if len(small) == 1:
                low[cp] = ord(small)
            if not ch.isalpha():
                kind[cp] = DIGIT
            elif unicodedata.category(ch) not in ("Lu", "Ll") or cp >= 0x250:
                kind[cp] = LETTER
            elif ch.isupper():
                kind[cp] = UPPER_VOWEL if small[0] in _VOWELS else UPPER
            else:
                kind[cp] = VOWEL if small in _VOWELS else CONSONANT
    for k, marks in _MARKS.items():
        kind[[ord(m) for m in marks]] = k
    kind[10], kind[9] = NEWLINE, TAB
    low[[ord("İ"), ord("I"), ord("ı")]] = ord("i")
    symbol = ~alnum & ~np.isin(kind, (SPACE, NEWLINE, TAB))
    symbol[[ord(c) for c in PLAIN]] = False
    return kind, alnum, low, symbol


_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[0] = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, 0x9E3779B97F4A7C15, np.uint64)])
    return _POWERS[0][:n]


@functools.cache
def _function_words() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the function words, and the word class of each."""
    classes: dict[int, int] = {}
    for i, known in enumerate(FUNCTION_WORDS.values()):
        for w in known:
            h = _hash_word(w)
            classes[h] = classes.get(h, 0) | (1 << i)
    for w in ARTICLES:
        classes[_hash_word(w)] = ARTICLE
    hashes = np.array(sorted(classes), np.uint64)
    return hashes, np.array([classes[int(h)] for h in hashes], np.int64)


def _hash_word(w: str) -> int:
    codes = _tables()[2][np.frombuffer(w.encode("utf-32-le"), np.uint32)].astype(np.uint64)
    with np.errstate(over="ignore"):
        return int((codes * _powers(len(codes))).sum(dtype=np.uint64))


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.r_[0, inside.view(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Counted:
    """Counts of some texts, held as one array of code points."""

    def __init__(self, texts: list[str]):
        kinds, alnum, low, symbol = _tables()
        codes = np.frombuffer("\n\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) + 2 for t in texts], np.int64)
        self.first = np.r_[0, np.cumsum(lengths)]  # each text with two line ends after it
        n = len(codes)
        k = kinds[codes]
        word = alnum[codes]
        before, after = np.r_[NEWLINE, k[:-1]].astype(np.uint8), np.r_[k[1:], NEWLINE].astype(np.uint8)
        word_before, word_after = np.r_[False, word[:-1]], np.r_[word[1:], False]
        newline, blank = k == NEWLINE, (k == SPACE) | (k == NEWLINE) | (k == TAB)
        # lines
        line_end = np.flatnonzero(newline)
        line_start = np.r_[0, line_end[:-1] + 1]
        line_of = np.cumsum(newline) - newline
        seen = ~blank
        at = np.flatnonzero(seen)
        first_seen = np.searchsorted(at, line_start)
        last_seen = np.searchsorted(at, line_end) - 1
        filled = last_seen >= first_seen
        lead = np.where(filled, at[np.minimum(first_seen, max(len(at) - 1, 0))] if len(at) else 0, line_start)
        closing = np.isin(k, (QUOTE, BRACKET, APOSTROPHE))
        body = np.flatnonzero(seen & ~closing)
        tail = np.searchsorted(body, line_end) - 1
        ended = filled & (tail >= 0) & (k[body[np.maximum(tail, 0)]] == STOP) & (body[np.maximum(tail, 0)] >= line_start) if len(body) else np.zeros(len(line_end), bool)
        # words: runs of letters and digits
        ws, we = _spans(word)
        wlen = we - ws
        wline = line_of[ws]
        offset = np.arange(n) - np.repeat(np.r_[0, ws], np.diff(np.r_[0, ws, n])) if len(ws) else np.arange(n)
        with np.errstate(over="ignore"):
            mixed = low[codes].astype(np.uint64) * _powers(int(wlen.max(initial=0)) + 1)[np.where(word, offset, 0)]
            mixed[~word] = 0
            wh = np.add.reduceat(mixed, ws) if len(ws) else np.empty(0, np.uint64)
        total = lambda flags: np.add.reduceat(flags.astype(np.int32), ws) if len(ws) else np.empty(0, np.int32)
        digits, vowels, other = total(k == DIGIT), total((k == VOWEL) | (k == UPPER_VOWEL)), total(k == LETTER)
        # a word's span in reduceat runs to the next word; only letters and digits are counted, so that changes nothing
        hashes, classes = _function_words()
        spot = np.minimum(np.searchsorted(hashes, wh), len(hashes) - 1)
        known = hashes[spot] == wh
        text_of = np.searchsorted(self.first, ws, "right") - 1
        capital = np.isin(k[ws], (UPPER, UPPER_VOWEL)) if len(ws) else np.empty(0, bool)
        with np.errstate(over="ignore"):
            own = wh ^ (text_of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        _, first_at = np.unique(own, return_index=True)
        again = np.ones(len(ws), bool)
        again[first_at] = False
        kind = np.where(again, REPEATED, np.where(capital, NEW_CAPITAL, NEW_LOWER))
        kind = np.where((wlen >= 3) & (vowels == 0) & (digits == 0) & (other == 0), UNSPEAKABLE, kind)
        kind = np.where(((digits > 0) & (digits < wlen)) | (wlen >= 25), MIXED, kind)
        kind = np.where(digits == wlen, NUMBER, kind)
        kind = np.where((wlen == 1) & (digits == 0), SINGLE, kind)
        wkind = np.where(known, classes[spot], kind)
        # forms of lines
        lines = len(line_end)
        nwords = np.bincount(wline, minlength=lines)
        per_line = lambda flags: np.bincount(line_of[flags], minlength=lines)
        tabs, pipes, semis = per_line(k == TAB), per_line(k == PIPE), per_line(k == SEMICOLON)
        commas, slashes, bullets = per_line((k == COMMA) & ~((before == DIGIT) & (after == DIGIT))), per_line(((k == SLASH) | (k == DASH)) & (before == SPACE) & (after == SPACE)), per_line(k == BULLET)
        labels, numbers = per_line((k == EQUALS) | ((k == COLON) & ~((before == DIGIT) & (after == DIGIT)))), np.bincount(wline[wkind == NUMBER], minlength=lines)
        gap = (k == SPACE) & (before == SPACE) & (np.r_[NEWLINE, before[:-1]] != SPACE) & (line_of == np.r_[0, line_of[:-1]])
        gaps = per_line(gap & (np.arange(n) > lead[line_of]))
        tight = per_line((k == COMMA) & (before == QUOTE) & (after == QUOTE))
        line_chars = np.bincount(line_of[seen], minlength=lines)
        legible = (per_line(word) >= 0.4 * line_chars) | (per_line((k == PIPE) | (k == DASH) | (k == COLON)) == line_chars)
        fielded = ((tabs > 0) & (tabs * 8 >= nwords)) | (pipes >= 2) | ((gaps >= 2) & (gaps * 4 >= nwords)) | (tight >= 1) | ((semis >= 2) & (numbers > 0) & (semis * 4 >= nwords)) | ((labels >= 1) & (numbers > 0) & (nwords <= 6))
        fielded &= legible
        strung = (semis + commas + slashes + bullets + pipes) * 2.6 >= nwords
        strung &= (semis + commas + slashes + bullets + pipes >= 3) & ~ended
        lk, nk = k[lead], k[np.minimum(lead + 1, n - 1)]
        number_lead = np.zeros(lines, bool)
        lead_word = np.searchsorted(ws, lead + np.isin(lk, (BRACKET,)))
        if len(ws):
            lw = np.minimum(lead_word, len(ws) - 1)
            stop = np.minimum(we[lw], n - 1)
            number_lead = (lead_word < len(ws)) & (ws[lw] <= lead + 1) & (wlen[lw] <= 4) & ((digits[lw] == wlen[lw]) | (wlen[lw] == 1)) & np.isin(codes[stop], (ord("."), ord(")"))) & (k[np.minimum(stop + 1, n - 1)] == SPACE)
        dashed = (wlen[lw] == digits[lw]) & (ws[lw] == lead) & (k[stop] == SPACE) & (k[np.minimum(stop + 1, n - 1)] == DASH) if len(ws) else False
        box = (codes[lead] == ord("[")) & (codes[np.minimum(lead + 2, n - 1)] == ord("]"))
        bulleted = (np.isin(lk, (DASH, BULLET)) & (nk == SPACE)) | number_lead | dashed | box
        solid = (line_chars >= 25) & (nwords * 25 <= line_chars)
        form = np.where(ended, ENDED, np.where(nwords <= 6, SHORT, OPEN))
        form = np.where(solid, SOLID, form)
        form = np.where(strung, STRUNG, form)
        form = np.where(bulleted & ~(ended & (nwords >= 5)), BULLETED, form)
        form = np.where(fielded & ~(ended & (nwords >= 8)), FIELDED, form)
        # segments: lines of one shape, apart from blank lines
        shape = np.where(form == FIELDED, 1, np.where(bulleted, 2, np.where(form == SOLID, 3, np.where(form == STRUNG, 4, 0))))
        full = np.flatnonzero(filled)
        if len(full):
            s = shape[full]
            cut = np.r_[True, (np.diff(full) > 1) | (np.diff(s) != 0)]
            seg_of_full = np.cumsum(cut) - 1
        else:
            cut, seg_of_full = np.empty(0, bool), np.empty(0, np.int64)
        self.segments = int(seg_of_full[-1]) + 1 if len(full) else 0
        seg_of_line = np.full(lines, -1, np.int64)
        seg_of_line[full] = seg_of_full
        self.text_of_segment = np.searchsorted(self.first, line_start[full[cut]], "right") - 1 if len(full) else np.empty(0, np.int64)
        # character classes in context
        c = k.astype(np.int64)
        upper = (k == UPPER) | (k == UPPER_VOWEL)
        c[upper & word_before] = INNER_UPPER
        c[upper & ~word_before] = UPPER
        c[(k == DIGIT) & ((word_before & (before != DIGIT)) | (word_after & (after != DIGIT)))] = MIXED_DIGIT
        c[(k == SPACE) & (before == SPACE)] = SPACE_RUN
        c[newline] = LINE_END
        c[line_end[ended]] = SENTENCE_LINE_END
        c[(k == STOP) & np.isin(after, (SPACE, NEWLINE, QUOTE, BRACKET))] = SENTENCE_STOP
        c[((k == STOP) | (k == COMMA)) & (before == DIGIT) & (after == DIGIT)] = NUMBER_MARK
        c[(k == COMMA) & ~np.isin(after, (SPACE, NEWLINE, DIGIT))] = TIGHT_COMMA
        c[(k == DASH) & (np.arange(n) == lead[line_of])] = LINE_DASH
        seg = seg_of_line[line_of]
        use = seg >= 0
        size = max(self.segments, 1)
        chars = np.bincount(seg[use] * N_CHARS + c[use], minlength=size * N_CHARS).reshape(size, N_CHARS)
        wseg = seg_of_line[wline]
        words = np.bincount(wseg * N_WORDS + wkind, minlength=size * N_WORDS).reshape(size, N_WORDS)
        forms = np.bincount(seg_of_line[full] * N_LINES + form[full], weights=line_chars[full], minlength=size * N_LINES).reshape(size, N_LINES)
        self.counts = np.concatenate([chars, words, forms], axis=1).astype(np.float64)[: self.segments]
        self.mass = np.bincount(seg[use & seen], minlength=size)[: self.segments].astype(np.float64)
        # basic counts by text: an apostrophe inside a word joins its parts
        m = len(texts)
        text_of_word = text_of
        inner = (k == APOSTROPHE) & word_before & word_after
        text_of_char = lambda flags: np.searchsorted(self.first, np.flatnonzero(flags), "right") - 1
        joined = np.bincount(text_of_char(inner), minlength=m)
        letters = np.bincount(text_of_word, weights=wlen, minlength=m) + joined
        self.parts = np.bincount(text_of_word, minlength=m)
        self.words = self.parts - joined
        self.mean = letters / np.maximum(self.words, 1)
        visible = np.bincount(text_of_char(seen), minlength=m)
        self.symbols = np.bincount(text_of_char(symbol[codes]), minlength=m) / np.maximum(visible, 1)
        text_of_line = np.searchsorted(self.first, line_start, "right") - 1
        some = np.bincount(text_of_line[filled], minlength=m)
        self.punctuated = np.bincount(text_of_line[ended], minlength=m) / np.maximum(some, 1)
        self.common = np.bincount(text_of_word[known], minlength=m) / np.maximum(self.parts, 1)
        self.visible = visible


def distributions(counts: np.ndarray) -> np.ndarray:
    """Each part of each row as shares; an empty part is all zero."""
    out = np.zeros_like(counts)
    for part in PARTS:
        total = counts[:, part].sum(axis=1, keepdims=True)
        np.divide(counts[:, part], total, out=out[:, part], where=total > 0)
    return out


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log2(np.maximum(x, 1e-12))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p from each row of q, the parts weighted."""
    weights = np.repeat(WEIGHTS, [part.stop - part.start for part in PARTS]).astype(float)
    own_p, own_q = _plogp(p) @ weights, _plogp(q) @ weights
    out = np.empty((len(p), len(q)))
    for j in range(len(q)):
        out[:, j] = (own_p + own_q[j]) / 2 - _plogp((p + q[j]) / 2) @ weights
    return out


def smoothed(counts: np.ndarray, floor: float = 2e-3) -> np.ndarray:
    return distributions(distributions(counts) + floor / N)


@functools.cache
def seeds() -> np.ndarray:
    """Counts of the exemplars."""
    return np.array([Counted([text]).counts.sum(axis=0) for text in EXEMPLARS.values()])


def counted_anew(counts: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Sums of the segments' counts by their nearest profile, of segments whose kind is clear."""
    d = divergence(distributions(counts), profiles)
    near, rows = d.argmin(axis=1), np.arange(len(d))
    rivals = np.where(OF_KIND[None, :] == OF_KIND[near][:, None], np.inf, d).min(axis=1)
    clear = d[rows, near] < CLEAR * rivals
    sums = np.zeros((len(OF_KIND), N))
    np.add.at(sums, near[clear], counts[clear])
    return sums


def kinds(counted: np.ndarray, mass: np.ndarray, text_of_segment: np.ndarray, texts: int, profiles: np.ndarray) -> list[str | None]:
    """Kind of each text: of its segments' nearest profiles the kind with most characters."""
    total = np.zeros((texts, len(KINDS)))
    if len(counted):
        near = divergence(distributions(counted), profiles).argmin(axis=1)
        np.add.at(total, (text_of_segment, OF_KIND[near]), mass)
    return [KINDS[k] if some else None for k, some in zip(total.argmax(axis=1), total.any(axis=1), strict=True)]


COUNTED = "revision_id long, stored_char_count long, stored_word_count long, words long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, segments binary"
CHARS_AT_ONCE = 1 << 20  # texts are counted together up to so many characters, a longer one alone


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*((c, pa.int64()) for c in ("revision_id", "stored_char_count", "stored_word_count", "words")), *((c, pa.float64()) for c in ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")), ("segments", pa.binary())])
    for batch in batches:
        texts = [x or "" for x in batch.column(3).to_pylist()]
        ends = np.cumsum([len(x) for x in texts])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS_AT_ONCE, "right")))
            c = Counted(texts[at:to])
            rows = np.concatenate([c.counts, c.mass[:, None]], axis=1).astype(np.uint32)
            cuts = np.searchsorted(c.text_of_segment, np.arange(to - at + 1))
            held = [rows[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            empty, wordless = c.visible == 0, c.words <= 0
            ratios = (pa.array(v, pa.float64(), mask=m) for v, m in ((c.mean, wordless), (c.symbols, empty), (c.punctuated, empty), (c.common, wordless)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in range(3)), pa.array(c.words, pa.int64()), *ratios, pa.array(held, pa.binary())], schema=schema)
            at = to


def _segments(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, characters, row) of the segments of a batch's texts."""
    held = batch.column("segments").to_pylist()
    rows = np.frombuffer(b"".join(held), np.uint32).reshape(-1, N + 1).astype(np.float64)
    return rows[:, :N], rows[:, N], np.repeat(np.arange(len(held)), [len(h) // (4 * (N + 1)) for h in held])


def fitted(counted: DataFrame) -> np.ndarray:
    """Profiles counted over all segments, starting from the exemplars."""
    profiles = smoothed(seeds())
    for _ in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], profiles=profiles) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(OF_KIND), N))
            for batch in batches:
                counts, _, _ = _segments(batch)
                if len(counts):
                    sums += counted_anew(counts, profiles)
            flat = sums.reshape(-1)
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.float64())], names=["k", "v"])

        got = counted.select("segments").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        sums = np.zeros(len(OF_KIND) * N)
        sums[got["k"].to_numpy(dtype=np.int64)] = got["v"]
        profiles = smoothed(sums.reshape(-1, N) + seeds())
    return profiles


SCHEMA = COUNTED.replace("segments binary", "kind string")


def statistics(docs: DataFrame, id_col: str = "revision_id", text_col: str = "content_text", chars_col: str = "char_count", words_col: str = "word_count") -> DataFrame:
    """One row of statistics for each revision, beside the stored counts."""
    rows = docs.select(docs[id_col].cast("long"), docs[chars_col].cast("long"), docs[words_col].cast("long"), docs[text_col].cast("string"))
    counted = written(spread(rows).mapInArrow(_count, COUNTED), "segments")  # the texts are read once, what follows reads counts
    profiles = fitted(counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = kinds(*_segments(batch), batch.num_rows, profiles)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=[*batch.schema.names[:-1], "kind"])

    return counted.mapInArrow(run, SCHEMA).distinct()


def not_prose(docs: DataFrame, **columns: str) -> DataFrame:
    """(revision_id, kind) of the texts that are mostly list, table or junk."""
    return statistics(docs, **columns).where("kind <> 'prose' and revision_id is not null").select("revision_id", "kind").distinct()
