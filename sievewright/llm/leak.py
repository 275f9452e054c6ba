"""Problem 8: passages of evaluation items inside corpus documents.

Texts become words without case, accents, punctuation, white space and
invisible characters, each word a 64-bit hash; all of it is done in numpy over
one array of code points. The evaluation items are a stated query set, read in
blocks bounded by bytes; a block's four-word seeds are held in a sorted hash
table, and one pass over the documents scans several blocks, so a document is
read into words once for all of them. No pair is formed without shared seeds.

Greedy string tiling by running Karp-Rabin: around the seeds that a document
shares with an item, hashes of all runs of 16, 8, 4 and 2 words are taken from
one running sum; the longest matches that do not overlap are marked, again and
again, before the next shorter length. An item whose words are covered by long
tiles in any order leaks as a whole. Else a stretch of the item as long as the
least passage must be covered by tiles that lie together in the document; an
exact local alignment of that place then checks that few words are replaced or
dropped.

Defined results: null, empty and blank texts leak nothing; items shorter than
the least passage leak if they occur whole; rows that repeat give one row;
documents of any length are scanned whole; null ids give no rows. Where the
scan has fewer splits than cores, the texts are spread by one shuffle.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from sievewright.tables import spread

SEED = 4
LEAST_WORDS = 18
ERRORS_IN = 10  # about one word in so many may be replaced or dropped
LENGTHS = (16, 8, 4, 2)  # of the runs that are searched, longest first
COVERED = 0.75  # share of a stretch's words that tiles must cover before it is aligned
WHOLE_COVERED = 0.9  # share of an item's words in long tiles, in any order
BLOCK_BYTES, PASS_BLOCKS = 16 << 20, 4  # item text in a block; blocks scanned in one pass over the documents
CHARS_AT_ONCE = 1 << 20
#: Characters inside a word that join its parts, so all spellings of "l'exemple" agree.
JOINERS = "'’ʼ`‘‐‑-"
#: Characters that are nothing.
NOTHING = [*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, 0x180E, 0x34F]
#: Elided articles join the next word.
ELIDED = ("l", "d", "c", "j", "m", "n", "s", "t", "qu")
_Q = 0x9E3779B97F4A7C15
_GAP, _JOIN = 1, 2  # codes of white space and of joiners


@functools.cache
def _fold() -> tuple[np.ndarray, dict[str, str]]:
    """Code point -> folded letter or digit, 0 for nothing, 1 white space, 2 joiner, 3 other; and what folds to several letters."""
    table, several = np.full(0x110000, 3, np.uint32), {}
    for cp in range(0x34000):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000:
            continue
        low = "i" if ch in "ıİ" else "".join(c for c in unicodedata.normalize("NFKD", ch).casefold() if not 0x300 <= ord(c) < 0x370)
        if not low or cp in NOTHING:
            table[cp] = 0
        elif len(low) == 1:
            table[cp] = ord(low) if low.isalnum() else _GAP if low.isspace() else 3
        elif any(c.isalnum() for c in low):
            several[ch] = low
            table[cp] = 4
        elif low[0].isspace():
            table[cp] = _GAP
    for cp in NOTHING:
        table[cp] = 0
    for ch in JOINERS:
        table[ord(ch)] = _JOIN
    return table, several


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, q in enumerate((_Q, pow(_Q, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, q, np.uint64)])
    return _POWERS[0][:n], _POWERS[1][:n]


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, inside.view(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hashes(codes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word."""
    ws, we = _runs(word)
    if not len(ws):
        return np.empty(0, np.uint64), ws, we
    offset = np.arange(len(codes)) - np.repeat(np.r_[0, ws], np.diff(np.r_[0, ws, len(codes)]))
    q, _ = _powers(int((we - ws).max()))
    mixed = np.where(word, codes.astype(np.uint64) * q[np.where(word, offset, 0)], np.uint64(0))
    return np.add.reduceat(mixed, ws), ws, we


@functools.cache
def _elided() -> np.ndarray:
    return np.sort([_hashes(np.array([ord(c) for c in w], np.uint32), np.ones(len(w), bool))[0][0] for w in ELIDED])


def worded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin and end."""
    table, several = _fold()
    raw = np.frombuffer("\x01".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = table[raw]
    if (codes == 4).any():
        texts = ["".join(several.get(c, c) for c in t) if not several.keys().isdisjoint(t) else t for t in texts]
        codes = table[np.frombuffer("\x01".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    codes[ends - 1] = 3  # ends of texts part words
    keep = codes != 0
    word = codes > 4
    inner = np.flatnonzero(keep)
    joiner = codes[inner] == _JOIN
    if joiner.any():  # joiners between letters or digits, whatever nothing stands between
        w = word[inner]
        drop = joiner & np.r_[False, w[:-1]] & np.r_[w[1:], False]
        keep[inner[drop]] = False
    where = np.cumsum(keep)
    bounds = np.r_[0, where[ends - 1]]
    codes = codes[keep]
    h, ws, we = _hashes(codes, codes > 4)
    short = np.isin(h[:-1], _elided()) & (we[:-1] - ws[:-1] <= 2) if len(h) else np.empty(0, bool)
    if short.any():
        blank = np.r_[0, np.cumsum(codes == _GAP)]
        only = blank[ws[1:]] - blank[we[:-1]] == ws[1:] - we[:-1]  # white space and nothing else up to the next word
        keep = np.ones(len(codes), bool)
        for a, b in zip(we[:-1][short & only], ws[1:][short & only], strict=True):
            keep[a:b] = False
        bounds = np.r_[0, np.cumsum(keep)][bounds]
        codes = codes[keep]
        h, ws, we = _hashes(codes, codes > 4)
    return h, np.searchsorted(ws, bounds)


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of the n words from each position, of one running sum."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    q, inverse = _powers(len(ids) + 1)
    total = np.r_[np.uint64(0), np.cumsum(ids * q[: len(ids)])]
    return (total[n:] - total[:-n]) * inverse[: len(ids) - n + 1]


def _expand(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each row, as often as its length."""
    return np.repeat(first, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Searched:
    """The words of an item with the sorted hashes of its runs of each length."""

    def __init__(self, words: np.ndarray, lengths: tuple[int, ...] = LENGTHS):
        self.words, self.listed, self.runs = words, words.tolist(), {}
        for n in lengths:
            if n <= len(words):
                h = windows(words, n)
                order = np.argsort(h, kind="stable")
                self.runs[n] = h[order], order


def tiling(item: Searched, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """Longest non-overlapping common tiles (place in item, place in document, words)."""
    busy_item, busy_doc, tiles = np.zeros(len(item.words) + 1, np.int32), np.zeros(len(doc) + 1, np.int32), []
    for n, (known, order) in item.runs.items():
        h = windows(doc, n)
        if not len(h):
            continue
        low = known.searchsorted(h, "left")
        at = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == h)
        if not len(at):
            continue
        low = low[at]
        lengths = known.searchsorted(h[at], "right") - low
        p, q = order[_expand(lengths, low)], np.repeat(at, lengths)
        by = np.lexsort((p, q - p))
        p, q = p[by], q[by]
        while len(p):
            if tiles:  # runs that touch a marked word are out
                total_i, total_d = busy_item.cumsum(), busy_doc.cumsum()
                free = (total_i[p + n - 1] - total_i[p] + busy_item[p] == 0) & (total_d[q + n - 1] - total_d[q] + busy_doc[q] == 0)
                p, q = p[free], q[free]
                if not len(p):
                    break
            cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1)) + 1
            starts = [0, *cut.tolist()]
            sizes = [b - a + n - 1 for a, b in zip(starts, [*starts[1:], len(p)], strict=True)]
            marked = False
            for size, i, j in sorted(zip([-x for x in sizes], p[starts].tolist(), q[starts].tolist(), strict=True)):
                to_i, to_j = i - size, j - size
                if not busy_item[i:to_i].any() and not busy_doc[j:to_j].any() and (item.words[i:to_i] == doc[j:to_j]).all():
                    busy_item[i:to_i] = busy_doc[j:to_j] = 1
                    tiles.append((i, j, -size))
                    marked = True
            if not marked:
                break
    return tiles


class Items:
    """One block of evaluation items, ready for scanning."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        h, bounds = worded([t for _, t in rows])
        self.words = [h[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        lengths = np.diff(bounds)
        seeds, owners, places = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}  # items of at most SEED words, by their number of words and hash
        for i, w in enumerate(self.words):
            if len(w) > SEED:
                seeds.append(windows(w, SEED))
                owners.append(np.full(len(w) - SEED + 1, i))
                places.append(np.arange(len(w) - SEED + 1))
            elif len(w):
                self.short.setdefault(len(w), {}).setdefault(int(windows(w, len(w))[0]), []).append(i)
        s = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(s, kind="stable")
        self.owner = np.concatenate(owners)[order] if seeds else np.empty(0, np.int64)
        self.place = np.concatenate(places)[order] if seeds else np.empty(0, np.int64)
        self.hash, first = np.unique(s[order], return_index=True)
        self.bounds = np.append(first, len(s))
        self.lengths, self.least = lengths, np.minimum(LEAST_WORDS, lengths)
        self.ready: dict[int, Searched] = {}

    def scan(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """(text, item id) of the items that each text contains."""
        found = []
        text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for n, known in self.short.items():
            w = windows(h, n)
            inside = text_of[: len(w)] == text_of[n - 1 :] if len(w) else np.empty(0, bool)
            for at in np.flatnonzero(inside & np.isin(w, np.fromiter(known, np.uint64, len(known)))):
                found += [(int(text_of[at]), self.ids[i]) for i in known[int(w[at])] if (self.words[i] == h[at : at + n]).all()]
        w = windows(h, SEED)
        if not len(w) or not len(self.hash):
            return found
        k = np.minimum(np.searchsorted(self.hash, w), len(self.hash) - 1)
        at = np.flatnonzero((self.hash[k] == w) & (text_of[: len(w)] == text_of[SEED - 1 :]))
        k = k[at]
        lengths = self.bounds[k + 1] - self.bounds[k]
        post, q = _expand(lengths, self.bounds[k]), np.repeat(at, lengths)
        p, pair = self.place[post], text_of[q] * len(self.ids) + self.owner[post]
        order = np.lexsort((q, q - p, pair))
        p, q, pair = p[order], q[order], pair[order]
        if not len(p):
            return found
        fresh = np.r_[True, (np.diff(pair) != 0) | (np.diff(p) != 1) | (np.diff(q) != 1)]
        # places of a document that share seeds with an item, and the words that the seeds can cover there
        order = np.lexsort((q, pair))
        q, pair, fresh = q[order], pair[order], fresh[order]
        first = np.flatnonzero(np.r_[True, (np.diff(pair) != 0) | (np.diff(q) > 2 * LEAST_WORDS)])
        last = np.r_[first[1:], len(q)]
        reach = last - first + (SEED - 1) * np.add.reduceat(fresh.astype(np.int64), first)
        pair = pair[first]
        item = pair % len(self.ids)
        head = np.flatnonzero(np.r_[True, np.diff(pair) != 0])
        whole = np.add.reduceat(reach, head) >= WHOLE_COVERED * self.lengths[item[head]]
        some = (reach >= np.maximum(self.least[item] // 2, SEED + 1)) | np.repeat(whole, np.diff(np.r_[head, len(pair)]))
        held: dict[int, list[np.ndarray]] = {}
        for k in np.flatnonzero(some):
            a, b = bounds[pair[k] // len(self.ids)], bounds[pair[k] // len(self.ids) + 1]
            held.setdefault(int(pair[k]), []).append(h[max(a, q[first[k]] - LEAST_WORDS) : min(b, q[last[k] - 1] + SEED + LEAST_WORDS)])
        for k, pieces in held.items():
            text, i = divmod(k, len(self.ids))
            if leaks(self.searched(i), pieces):
                found.append((text, self.ids[i]))
        return found

    def searched(self, i: int) -> Searched:
        if i not in self.ready:
            self.ready[i] = Searched(self.words[i])
        return self.ready[i]


def most_covered(covered: np.ndarray, n: int) -> int:
    """Most covered words in n consecutive ones."""
    total = np.r_[0, np.cumsum(covered)]
    return int((total[n:] - total[:-n]).max())


def leaks(searched: Searched, pieces: list[np.ndarray]) -> bool:
    """Whether the pieces of a document, around the seeds it shares with an item, hold a passage of the item or all of it."""
    item = searched.words
    least = min(LEAST_WORDS, len(item))
    long_tiles = []
    for piece in pieces:
        among = set(piece.tolist())  # tiles can't cover more than the words that occur at all
        there = np.fromiter((w in among for w in searched.listed), bool, len(item))
        if most_covered(there, least) < COVERED * least:
            long_tiles.append(int(there.sum()))
            continue
        tiles = tiling(searched, piece)
        long_tiles.append(sum(n for _, _, n in tiles if n > SEED + 1))
        if long_tiles[-1] >= WHOLE_COVERED * len(item):
            return True
        covered = np.zeros(len(item), bool)
        for i, _, n in tiles:
            covered[i : i + n] = True
        if most_covered(covered, least) < COVERED * least:
            continue
        score, span = passage(item, piece)
        # a word replaced by two counts twice as an error, which long matches may do
        if score >= least_score(len(item)) and (score >= LEAST_WORDS + 2 or (span - score) / (1 + MISS) <= span / ERRORS_IN + 1):
            return True
    if len(pieces) < 2 or sum(long_tiles) < WHOLE_COVERED * len(item):
        return False
    apart = np.concatenate([np.r_[piece, np.uint64(0)] for piece in pieces])  # parts of the item far from each other
    return sum(n for _, _, n in tiling(searched, apart) if n > SEED + 1) >= WHOLE_COVERED * len(item)


MISS = 2.0  # a replaced or dropped word costs two matching ones


EDGE = 1.5  # what an error near the passage's end takes from its score


def least_score(item_words: int) -> float:
    n = min(LEAST_WORDS, item_words)
    errors = n // ERRORS_IN
    return n - errors - MISS * errors - EDGE


def passage(item: np.ndarray, doc: np.ndarray) -> tuple[float, int]:
    """Best local alignment: (matching words less misses, words of the item in it)."""
    n = len(doc)
    score, start = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
    best, span = 0.0, 0
    ramp = MISS * np.arange(n + 1)
    for i, w in enumerate(item):
        same = doc == w
        diagonal = score[:-1] + np.where(same, 1.0, -MISS)
        up = score[1:] - MISS
        now = np.zeros(n + 1)
        now[1:] = np.maximum(np.maximum(diagonal, up), 0)
        begin = np.full(n + 1, i + 1)
        take = now[1:] > 0
        begin[1:] = np.where(take, np.where(diagonal >= up, np.where(score[:-1] > 0, start[:-1], i), start[1:]), i + 1)
        left = np.maximum.accumulate(now + ramp) - ramp  # words of the document that the item lacks
        moved = left > now
        if moved.any():
            source = np.maximum.accumulate(np.where(moved, 0, np.arange(n + 1)))
            begin = np.where(moved, begin[source], begin)
            now = left
        score, start = now, begin
        k = int(score.argmax())
        if score[k] > best:
            best, span = float(score[k]), i + 1 - int(start[k])
    return best, span


_READY: dict[str, Items] = {}  # indexes that this worker holds, at most those of one pass


def _ready(name: str, block: Broadcast) -> Items:
    if name not in _READY:
        while len(_READY) >= PASS_BLOCKS:
            _READY.pop(next(iter(_READY)))
        _READY[name] = Items(block.value)
    return _READY[name]


def blocks(rows: Iterator[tuple[int, str]], size: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    held, n = [], 0
    for item, text in rows:
        if held and n + len(text) > size:
            yield held
            held, n = [], 0
        held.append((item, text))
        n += len(text)
    if held:
        yield held


def leaked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id) of every document that holds a passage of an item."""
    spark = docs.sparkSession
    rows = items.select(items[item_col].cast("long"), items[item_text_col].cast("string")).where(items[item_text_col].isNotNull() & items[item_col].isNotNull()).distinct()
    texts = spread(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("doc_id is not null and text is not null"))
    schema = "doc_id long, item_id long"
    out = spark.createDataFrame([], schema)

    def scan_pass(held: list) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch.column(0), []
                docs_text = batch.column(1).to_pylist()
                ends = np.cumsum([len(t) for t in docs_text])
                at = 0
                while at < len(docs_text):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS_AT_ONCE, "right")))
                    h, bounds = worded(docs_text[at:to])
                    for name, block in held:
                        found += [(at + d, i) for d, i in _ready(name, block).scan(h, bounds)]
                    at = to
                where = pa.array([d for d, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(where), pa.array([i for _, i in found], pa.int64())], names=["doc_id", "item_id"])

        return texts.mapInArrow(scan, schema)

    held = []
    for block in blocks(tuple(r) for r in rows.toLocalIterator()):  # a block at a time, never all items of a large set
        held.append((uuid.uuid4().hex, spark.sparkContext.broadcast(block)))
        if len(held) == PASS_BLOCKS:
            out, held = out.unionByName(scan_pass(held)), []
    if held:
        out = out.unionByName(scan_pass(held))
    return out.distinct()
