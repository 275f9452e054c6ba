"""Text, hash and bit functions as Columns; Arrow functions where Spark has none."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

#: White space that isn't one plain space already: replacing only that spares most of the work.
SPACES = r"[ \t\n\r\f\x0b]{2,}|[\t\n\r\f\x0b]"
TOKEN = r"[\p{L}\p{N}_]+"
LEAST_CHARS = 32  # shorter texts get no fingerprint
GRAM, LEAST_TOKENS = 3, 5


@F.pandas_udf(StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    """NFKC, case folding, white space collapsed and trimmed; null stays null."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def profile_text(c: Column) -> Column:
    """normalize_text without NFKC, in built-in expressions only."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.replace(c, F.lit("İ"), F.lit("i"))), F.lit("ß"), F.lit("ss")), SPACES, " "))


PROFILE_SQL = r"trim(regexp_replace(replace(lower(replace({0}, 'İ', 'i')), 'ß', 'ss'), '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ')"


def fingerprint(normal: Column) -> Column:
    return F.when(F.char_length(normal) >= LEAST_CHARS, F.sha2(normal, 256))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), 0)


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a unit separator; empty for shorter lists."""
    size = F.size(words)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), "\x1f"))).otherwise(F.array().cast("array<string>"))


def fold_turkish(c: Column) -> Column:
    """Lower case with dotted and dotless i kept apart."""
    return F.lower(F.translate(c, "Iİ", "ıi"))


def fold_ascii(c: Column) -> Column:
    return F.translate(c, "çğıöşüâîûÇĞİÖŞÜÂÎÛ", "cgiosuaiuCGIOSUAIU")


def subtag(c: Column) -> Column:
    """Primary subtag of a language tag."""
    return F.nullif(F.split(F.lower(F.trim(c)), "[-_]").getItem(0), F.lit(""))


def single_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def storage_key(sha: Column) -> Column:
    return F.concat(F.lit("objects/sha256/"), F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2), F.lit("/"), sha)


def basis_points(part: Column, whole: Column) -> Column:
    """part / whole in hundredths of a percent, half up, null for an empty whole."""
    return F.when(whole > 0, F.floor((part * 10000 + F.floor(whole / 2)) / whole).cast("long"))


def format_points(points: Column) -> Column:
    return F.format_string("%d.%02d", F.floor(points / 100).cast("long"), (points % 100).cast("long"))


def simhash(person: bytes = b"", digest: str = "blake2b"):
    """Arrow function: 64-bit SimHash of word 3-grams by strict majority; null under five words.

    digest 'md5' takes the first eight bytes of MD5, which SQL can check.
    """

    def bits(gram: bytes) -> bytes:
        return hashlib.blake2b(gram, digest_size=8, person=person).digest() if digest == "blake2b" else hashlib.md5(gram).digest()[:8]

    word = re.compile(r"[^\W]+")

    @F.pandas_udf(LongType())
    def signature(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = word.findall(t) if t is not None else []
            if len(words) < LEAST_TOKENS:
                out.append(None)
                continue
            grams = ("\x1f".join(words[i : i + GRAM]).encode() for i in range(len(words) - GRAM + 1))
            raw = np.frombuffer(b"".join(map(bits, grams)), dtype=np.uint8).reshape(-1, 8)
            ones = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
            out.append(int(np.packbits(ones * 2 > len(raw)).view(">u8")[0].astype(np.int64)))
        return pd.Series(out, dtype="Int64")

    return signature


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity_points(distance: Column) -> Column:
    return F.floor(((64 - distance) * 10000 + 32) / 64).cast("long")


def bit_string(c: Column) -> Column:
    return F.lpad(F.bin(c), 64, "0")


def luhn_valid(digits: Column) -> Column:
    """Luhn check of 13 to 19 digits that are not all alike."""
    return F.char_length(digits).between(13, 19) & F.call_function("luhn_check", digits) & ~digits.rlike(r"^(\d)\1+$")


def _digit(c: Column, i: int) -> Column:
    return F.substring(c, i, 1).try_cast("int")


def national_id_valid(digits: Column) -> Column:
    """Both check digits of an 11-digit national number."""
    odd = sum((_digit(digits, i) for i in (3, 5, 7, 9)), _digit(digits, 1))
    even = sum((_digit(digits, i) for i in (4, 6, 8)), _digit(digits, 2))
    tenth = F.pmod(odd * 7 - even, F.lit(10))
    return digits.rlike("^[1-9][0-9]{10}$") & (tenth == _digit(digits, 10)) & ((odd + even + _digit(digits, 10)) % 10 == _digit(digits, 11))


def mobile_valid(digits: Column) -> Column:
    """Ten digits from 5, with or without the country code or a leading zero."""
    n = F.char_length(digits)
    bare = F.when((n == 12) & digits.startswith("90"), F.substring(digits, 3, 10)).when((n == 11) & digits.startswith("0"), F.substring(digits, 2, 10)).otherwise(digits)
    return bare.rlike("^5[0-9]{9}$")


def iban_valid(iban: Column) -> Column:
    """Remainder 1 modulo 97 of a Turkish IBAN, digit by digit."""
    moved = F.concat(F.substring(iban, 5, 22), F.lit("2927"), F.substring(iban, 3, 2))
    rest = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(28)), lambda i: F.substring(moved, i, F.lit(1)).try_cast("int")), F.lit(0), lambda a, d: (a * 10 + d) % 97)
    return iban.rlike("^TR[0-9]{24}$") & (rest == 1)


@F.pandas_udf(LongType())
def deflate_permille(texts: pd.Series) -> pd.Series:
    """Compressed size per thousand bytes; null for empty texts."""

    def one(t: str | None) -> int | None:
        raw = (t or "").encode()
        return len(zlib.compress(raw, 9)) * 1000 // len(raw) if raw else None

    return texts.map(one).astype("Int64")


WINDOW, SHORTEST, LONGEST, CHAIN = 32768, 4, 258, 24
LITERAL_BITS, MATCH_BITS = 9, 25


def lz77_permille_of(t: str | None) -> int | None:
    """Size in whole bytes of a greedy sliding-window coding with fixed costs, per thousand; 1000 for an empty text, null for none."""
    if t is None:
        return None
    raw = t.encode()
    if not raw:
        return 1000
    heads: dict[bytes, list[int]] = {}
    bits = i = 0
    while i < len(raw):
        best = 0
        for at in reversed(heads.get(raw[i : i + SHORTEST], [])[-CHAIN:]):
            if i - at > WINDOW:
                break
            n = 0
            while n < LONGEST and i + n < len(raw) and raw[at + n] == raw[i + n]:
                n += 1
            best = max(best, n)
        step = best if best >= SHORTEST else 1
        bits += MATCH_BITS if best >= SHORTEST else LITERAL_BITS
        for k in range(i, min(i + step, len(raw) - SHORTEST + 1)):
            own = heads.setdefault(raw[k : k + SHORTEST], [])
            own.append(k)
            if len(own) > 4 * CHAIN:
                del own[: 3 * CHAIN]
        i += step
    return -(-bits // 8) * 1000 // len(raw)


@F.pandas_udf(LongType())
def lz77_permille(texts: pd.Series) -> pd.Series:
    return texts.map(lz77_permille_of).astype("Int64")


def pack_text(text: str | None, limit: int = 4000) -> list[str]:
    """Paragraphs packed into pieces of at most limit characters.

    A longer paragraph is split at its last space within the limit, or at the limit.
    """
    pieces: list[str] = []
    held = ""
    for paragraph in (text or "").split("\n"):
        rest = paragraph.strip()
        while rest:
            if len(rest) > limit:
                cut = rest.rfind(" ", 1, limit + 1)
                cut = cut if cut > 0 else limit
                part, rest = rest[:cut].rstrip(), rest[cut:].lstrip()
            else:
                part, rest = rest, ""
            if held and len(held) + 1 + len(part) <= limit:
                held += "\n" + part
            else:
                if held:
                    pieces.append(held)
                held = part
    return [*pieces, held] if held else pieces


@F.pandas_udf(ArrayType(StringType()))
def packed(texts: pd.Series) -> pd.Series:
    return texts.map(pack_text)
