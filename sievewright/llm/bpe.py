"""Problem 7: byte-level BPE of whole corpora in batched numpy merge rounds.

A batch's distinct new words become one flat array of byte symbols. In each
round the ranks of all neighbouring pairs are found by binary search over the
sorted pair keys, every word takes its lowest rank, and all occurrences of
that pair that don't overlap are merged at once, from the left. Words keep
their ids in a cache of bounded size, so each distinct word is merged once.

Defined results: null and empty texts have the empty list; special-token
strings are ordinary text; texts are encoded whole at any length; a null
document id is kept.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievewright.tables import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into words; fixed value of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_PAIR = np.int64(1 << 40)
CACHED_WORDS = 400_000


@functools.lru_cache(maxsize=4)
def load(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of each byte, sorted pair keys, merged id of each key)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
    keys, merged = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 20 | right)
                merged.append(rank)
    order = np.argsort(np.array(keys, dtype=np.int64))
    return single, np.array(keys, dtype=np.int64)[order], np.array(merged, dtype=np.int64)[order]


def merge(words: list[bytes], path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, where each word starts, with the end)."""
    single, keys, merged = load(path)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    flat = single[np.frombuffer(b"".join(words), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    done_ids, done_owner = [], []
    while len(flat):
        pair = np.full(len(flat), NO_PAIR)
        if len(flat) > 1:
            same = owner[1:] == owner[:-1]
            key = flat[:-1] << 20 | flat[1:]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            pair[:-1] = np.where(same & (keys[at] == key), merged[at], NO_PAIR)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        least = np.repeat(np.minimum.reduceat(pair, starts), np.diff(np.r_[starts, len(flat)]))
        finished = least == NO_PAIR
        if finished.any():
            done_ids.append(flat[finished])
            done_owner.append(owner[finished])
            keep = ~finished
            flat, owner, pair, least = flat[keep], owner[keep], pair[keep], least[keep]
            if not len(flat):
                break
        chosen = pair == least
        # of occurrences that overlap in a row, the first, third and so on
        index = np.arange(len(chosen))
        run_start = np.maximum.accumulate(np.where(chosen & ~np.r_[False, chosen[:-1]], index, 0))
        chosen &= (index - run_start) % 2 == 0
        flat = np.where(chosen, pair, flat)
        keep = ~np.r_[False, chosen[:-1]]
        flat, owner = flat[keep], owner[keep]
    ids = np.concatenate(done_ids) if done_ids else np.empty(0, np.int64)
    owners = np.concatenate(done_owner) if done_owner else np.empty(0, np.int64)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return ids[order], np.r_[0, np.cumsum(counts)]


class Encoder:
    def __init__(self, path: str = VOCABULARY):
        import regex

        self.path, self.split = path, regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.bounds = np.empty(0, np.int32), np.zeros(1, np.int64)

    def batch(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of each text."""
        if len(self.index) > CACHED_WORDS:
            self._reset()
        index, at, counts, new = self.index, [], [], []
        for text in texts:
            words = self.split(text) if text else []
            counts.append(len(words))
            for w in words:
                i = index.get(w)
                if i is None:
                    i = index[w] = len(index)
                    new.append(w)
                at.append(i)
        if new:
            ids, bounds = merge([w.encode("utf-8") for w in new], self.path)
            self.bounds = np.r_[self.bounds, bounds[1:] + self.bounds[-1]]
            self.ids = np.r_[self.ids, ids.astype(np.int32)]
        at = np.array(at, dtype=np.int64)
        first, size = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        ends = np.cumsum(size)
        gather = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
        before = np.r_[0, np.cumsum(np.array(counts, dtype=np.int64))]
        offsets = np.r_[0, ends][before].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.ids[gather]))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.batch(part.column(1).to_pylist())], names=["doc_id", "ids"])

    rows = docs.select(docs[id_col].cast("long"), docs[text_col].cast("string"))
    return spread(rows).mapInArrow(run, "doc_id long, ids array<int>")
