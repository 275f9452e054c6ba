"""Problem 5: personal data in free text.

Each line is searched for seven types; numbers count only where their check
digits hold, telephone numbers where their length fits the numbering plan.
Names are read from shape and context: a given name or a title before words
in capitals or in title case, less what marks streets, institutions and plain
sentences. Dates of birth are found too, but only for masking.

Findings are replaced by typed placeholders that carry a keyed pseudonym:
validated numbers and dates are permuted within their format by a Feistel
network and check digits are computed anew, so equal values stay linked across
documents and formats stay valid; other values get a keyed tag. The letters of
an IBAN and the digits of a phone before its last seven stay as they are.
Without a key a new one is drawn for the run, so that nobody can reverse the
pseudonyms; a kept key links runs.

Defined results: null and empty texts have no findings and come back as they
are; line numbers count from 1 at line feeds; where findings overlap the
earlier type in PRIORITY wins; redelivered revisions give one row; without an
id nothing tells a redelivery, so each such row stays in the masked texts and
none is in found_lines; very long lines are searched whole.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.tables import spread

TYPES = ("email", "iban", "payment_card", "id_number", "phone", "address", "person_name")
PRIORITY = (*TYPES[:5], "birth_date", *TYPES[5:])

#: Turkish "et" is also a French and a Turkish word: in brackets it needs a host with a dot after it, bare a host with "nokta" that no ordinary phrase makes.
ET = r"\s?[\[({]\s?et\s?[\])}]\s?(?=[\w-]+(?:\.[a-z]|\s?[\[({]\s?(?:nokta|dot)\b|\s+(?:nokta|dot)\s))|\s+et\s+(?!(?:bir|her|bu|şu|o|son|ilk|tek|iki|üç)\s)(?=[\w-]+(?:\s+nokta\s|\s?[\[({]\s?nokta\b))"
AT = rf"(?:\s?@\s?|\s?[\[({{]\s?at\s?[\])}}]\s?|\s+at\s+(?=[\w-]+\s+dot\s)|{ET})"
DOT = r"(?:\s?\.\s?|\s?[\[({]\s?(?:dot|nokta)\s?[\])}]\s?|\s+(?:dot|nokta)\s+)"
EMAIL = re.compile(rf"(?<![\w.+-])[a-z0-9](?:[\w.+-]*\w)?{AT}[a-z0-9][\w-]*(?:(?:\.|{DOT})[a-z][\w-]+)+", re.I)
IBAN = re.compile(r"(?<!\w)([A-Za-z]{2})(\d{2})(?=[ -]?[A-Za-z0-9])")
IBAN_PART = re.compile(r"[ -]?[A-Za-z0-9]")
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
CARD = re.compile(r"(?<![\w])(?<!\d[-. ])\d{4}([ .-]?)\d{4}\1\d{4}\1\d{4}(?!\w)(?![-. ]\d)")
ID_NUMBER = re.compile(r"(?<!\w)(?<!\d[-.])[1-9](?:[ .-]?\d){10}(?!\w)(?![-.]\d)")
PHONE = re.compile(
    r"(?<![\w+])(?<!\d[-./])"
    r"(?:(?:(?:\+|00)?90[ .-]?|0[ .-]?)?\(?0?[ ]?5\d{2}\)?|(?:(?:\+|00)?90[ .-]?\(?0?|\(?0[ .-]?\(?)[2-4]\d{2}\)?)"
    r"[ .-]?\d{3}[ .-]?\d{2}[ .-]?\d{2}(?!\w)(?![-./]\d)"
)
#: Numbers of other countries: with a country code after + or 00, or in the national form of France, Germany, Britain and North America.
OTHER_PHONE = re.compile(
    r"(?<![\w+])(?<!\d[-./ ])(?<![\da-f]{2} )(?:"
    r"(?:\+|00[ .-]?)(?!90)[1-9]\d{0,2}(?:[ .-]?\(0?\d{0,4}\))?(?:[ .-/]?\d){6,12}"
    r"|0[1-9](?:[ .]\d\d){4}(?! [\da-f]{2}\b)"
    r"|\(0\d{2,4}\)[ .-]?\d{3,4}(?:[ .-]?\d){3,5}"
    r"|0(?:1[5-7]\d|20|30|40|69|89|1\d{3}|7\d{3})[ /-]\d{3,4}[ -]?\d{3,5}"
    r"|(?:1[ .-])?\([2-9]\d{2}\)[ .-]?[2-9]\d{2}[ .-]\d{4}"
    r")(?!\w)(?![-./]\d)"
)
BIRTH = re.compile(r"(?:doğum(?:\s+tarihi)?|doğumlu|d\.?\s?tarihi|born(?:\s+on)?|date of birth|birth\s?date|dob|geb(?:oren|\.)(?:\s+am)?|geburtsdatum|née?(?:\s+le)?|date de naissance)\s*[:=(]?\s*(\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{2}-\d{2})(?!\d)", re.I)
DATE = re.compile(r"(\d{4})-(\d{2})-(\d{2})|(\d{1,2})([./-])(\d{1,2})\5(\d{4})")
#: Parts of street words in small letters; a line without any of them is not searched for addresses.
STREET = ("cad", "sok", "bulvar", "blv", "yolu", "çıkmaz", "sk", "cd", "straße", "strasse", "str.", "gasse", "allee", "platz", "weg", "street", "road", "avenue", "lane", "drive", "square", "rue", "boulevard", "quai", "place", "impasse", "chemin")
NAMEWORD = r"[^\W\d_][\w'’-]*"
ADDRESS = re.compile(
    rf"(?:{NAMEWORD}\s+)(?:caddesi|caddesı|cadde|cad|cd|sokağı|sokagi|sokak|sok|sk|bulvarı|bulvar|blv|yolu|çıkmazı)\b\.?\s*,?\s*(?:(?:no|numara|nr)\b\s*[.:]?\s*)?\d+(?:\s?/\s?\d+)?"
    rf"|(?<!\w){NAMEWORD}(?:straße|strasse|str\.|gasse|allee|platz|weg)\s+\d+[a-z]?(?!\w)"
    rf"|(?<![\w.,])\d+[a-z]?,?\s+(?:{NAMEWORD}\s+){{1,2}}(?:street|road|avenue|lane|drive|square)(?!\w)"
    rf"|(?<![\w.,])\d+(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|quai|place|impasse|chemin)\s+(?:de\s|du\s|des\s|d['’]|la\s|le\s|les\s|l['’]){{0,2}}\s*{NAMEWORD}"
    rf"|(?<!\w)(?:rue|avenue|boulevard)\s+(?:de\s|du\s|des\s|d['’]|la\s|l['’]){{0,2}}{NAMEWORD},?\s+(?:n[°o]\s?)?\d+(?![\w.,]\d)",
    re.I,
)
#: Common given names, folded; a parameter of Finder.
GIVEN_NAMES = frozenset(
    """ahmet ali alp arda aslı ayşe ayhan aylin barış berk berna burak burcu bülent can canan cem cemal ceren çağla çağrı defne deniz derya dilek ebru ece
    elif emine emre engin ercan erdem eren erkan esra fatma fatih ferhat filiz gamze gizem gökhan gül gülsüm hakan hande hasan hatice hüseyin ibrahim ipek ismail kemal
    kerem koray leyla mehmet melek melis meltem merve meryem metin murat mustafa nazlı nil nur nuray okan onur orhan osman ozan ömer özge özlem pelin pınar
    ramazan recep salih seda selim selin sema serkan sevgi sibel sinan süleyman şerife şule tolga tuba tuğçe ufuk umut uğur ümit volkan yasemin yasin yusuf zehra zeynep
    adam alice andrew anna anne charles christopher claire daniel david edward elizabeth emily emma george hannah henry jack james jane john julia kate laura margaret mary maria michael
    oliver paul peter philip robert sarah simon sophie thomas william andreas hans heinrich jürgen karl klaus martin monika petra sabine stefan wolfgang
    antoine catherine françois hélène jacques jean louis lucas marie nicolas philippe pierre wojciech""".split()
)
#: Titles and marks after which two words in capitals or title case are a name.
TITLE = re.compile(r"(?:\b(?:sayın|bay|bayan|dr|prof|doç|av|op|mr|mrs|ms|miss|sir|herrn?|frau|monsieur|madame|mme|mlle)\b\.?|\b(?:imza|i̇mza|signed|gezeichnet|signé)\s*:)[ \xa0]{1,2}$", re.I)
#: Forms of surnames: endings of common families of names, and Turkish names made of two words. They decide only where a given name is a mere initial, comes last or is written in small letters.
SURNAME_ENDINGS = ("oğlu", "soy", "gil", "türk", "baş", "kaya", "kan", "demir", "taş", "alp", "han", "lı", "li", "lu", "lü", "cı", "ci", "er", "mann", "berg", "son", "stein", "ski", "wicz", "sen", "eau", "ez")
COMPOUND = re.compile(r"(?:gün|koz|bey|doğru|çam|yeşil|akça|kara|sarı|boz|taş|öz|demir|er|kıran|ulu|ak|gök|kızıl)\w{3,}(?:oğlu|soy|gil|bel|li|lı|kan|er|baş|cık|cik)$")
#: Words that follow a given name without being a surname: parts of sentences and possessive forms.
POSSESSIVE = re.compile(r"(?:s[ıi]|[uüoö]s[uü]|l[ae]r[ıi]|n[ıiuü]n)$")
NO_SURNAME = frozenset("the and of in on at is was has had said says with from ve ile için bey hanım hoca hocam usta efendi abi abla teyze amca und der die das den im ist war hat sagte et le la les de du dit est avait a".split())
NOT_A_PERSON = frozenset("hatun ilkokulu ortaokulu lisesi okulu üniversitesi caddesi caddesı sokağı sokak mahallesi bulvarı bulvar meydanı parkı hastanesi camii camisi vakfı derneği köprüsü stadı müzesi kütüphanesi apartmanı sitesi barajı street straße road school university hospital".split())
TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")
DIGITS = re.compile(r"\d")
LETTERS = re.compile(r"[^\W\d_]+")
INITIAL = re.compile(r"(?<!\w)[A-ZÇĞİÖŞÜ]\.[ \xa0]")
TITLE_WORDS = frozenset("sayın bay bayan dr prof doç av op mr mrs ms miss sir herr herrn frau monsieur madame mme mlle imza signed gezeichnet signé".split())
FIELD_END = re.compile(r"[;|\t/–:•*-][ \xa0]*$|\b(?:sayın|imza|by|bölümü|kişi|olarak)[ \xa0:]+$", re.I)
FIELD_START = re.compile(r"[ \xa0]*(?:$|[;|\t/–:,.()]|- )")
JOIN = re.compile(r"[ \xa0]{1,2}$")
COMMA = re.compile(r" ?,[ \xa0]{0,2}$")


def fold(s: str) -> str:
    return s.replace("İ", "i").replace("I", "ı").lower().rstrip(".")


def fold_latin(s: str) -> str:
    return s.replace("İ", "i").lower().rstrip(".")


def digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def luhn(d: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(d)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0 and len(set(d)) > 1


def id_checks(first: str) -> str:
    """The two check digits of a national number's first nine digits."""
    d = [int(x) for x in first]
    tenth = (7 * sum(d[0::2]) - sum(d[1:8:2])) % 10
    return f"{tenth}{(sum(d) + tenth) % 10}"


def iban_rest(s: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in s[4:] + s[:4])) % 97


class Finder:
    def __init__(self, given: frozenset[str] = GIVEN_NAMES, dates: bool = False):
        self.given, self.dates = given, dates

    def line(self, line: str) -> list[tuple[int, int, str]]:
        """(start, end, type) of the findings of a line, in order and apart."""
        found: list[tuple[int, int, str]] = []
        has_digits = len(DIGITS.findall(line))
        low = line.replace("İ", "i").lower()  # regular expressions run only where a plain search finds their words
        words = LETTERS.findall(low)

        def add(a: int, b: int, kind: str) -> None:
            if all(b <= x or a >= y for x, y, _ in found):
                found.append((a, b, kind))

        if "@" in line or "at" in words or "et" in words:
            for m in EMAIL.finditer(line):
                add(*m.span(), "email")
        if has_digits >= 10:
            for m in IBAN.finditer(line):
                end = iban_end(line, m.start(), IBAN_LENGTHS.get(m[1].upper(), 0))
                if end and iban_rest(re.sub(r"[ -]", "", line[m.start() : end]).upper()) == 1:
                    add(m.start(), end, "iban")
            for m in CARD.finditer(line):
                if luhn(digits(m[0])):
                    add(*m.span(), "payment_card")
            for m in ID_NUMBER.finditer(line):
                d = digits(m[0])
                if id_checks(d[:9]) == d[9:]:
                    add(*m.span(), "id_number")
            for m in PHONE.finditer(line):
                add(*m.span(), "phone")
            for m in OTHER_PHONE.finditer(line):
                if 9 <= len(digits(m[0]).removeprefix("00")) <= 15:
                    add(*m.span(), "phone")
        if self.dates and has_digits >= 6:
            for m in BIRTH.finditer(line):
                if day_of(m[1]) is not None:
                    add(*m.span(1), "birth_date")
        if has_digits and any(part in low for part in STREET):
            for m in ADDRESS.finditer(line):
                add(*m.span(), "address")
        if self._may_name(line, words):
            for a, b in self.names(line):
                add(a, b, "person_name")
        return sorted(found)

    def _given(self, t: str) -> bool:
        return fold(t) in self.given or fold_latin(t) in self.given

    @staticmethod
    def _initial(t: str) -> bool:
        return len(t) == 2 and t[1] == "." and t[0].isupper()

    @staticmethod
    def _plain(t: str) -> bool:
        """A word that no person is called by."""
        f = fold(t)
        return len(f) < 2 or t.endswith(".") or f in NOT_A_PERSON or f in NO_SURNAME

    def _surname(self, t: str, given: str, known: bool) -> bool:
        """Whether t can be the surname after a given name (known) or a mere initial."""
        f = fold(t).partition("'")[0].partition("’")[0]
        if self._plain(t):
            return False
        if COMPOUND.match(f):
            return t[:1].isupper() or given[:1].islower()
        formed = len(f) >= 5 and f.endswith(SURNAME_ENDINGS)
        return t[:1].isupper() and (formed or (known and given[:1].isupper() and POSSESSIVE.search(f) is None))

    def names(self, line: str) -> Iterator[tuple[int, int]]:
        tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(line)]
        tokens = [(a, b - 1, t[:-1]) if t.endswith(".") and len(t) > 2 else (a, b, t) for a, b, t in tokens]
        n, i = len(tokens), 0
        near = lambda j: j < n and JOIN.match(line[tokens[j - 1][1] : tokens[j][0]]) is not None
        while i < n:
            a, b, t = tokens[i]
            j = i
            while j < n and (j == i or near(j)) and (self._given(tokens[j][2]) or self._initial(tokens[j][2])):
                j += 1
            known = any(self._given(x[2]) for x in tokens[i:j])
            if j > i and near(j) and self._surname(tokens[j][2], t, known) and not self._place(line, tokens, j):
                yield a, tokens[j][1]
                i = j + 1
                continue
            titled = t[:1].isupper() and not self._given(t) and near(i + 1) and TITLE.search(line, max(0, a - 24), a)
            if titled and tokens[i + 1][2][:1].isupper() and (self._initial(t) or not self._plain(t)) and not self._plain(tokens[i + 1][2]) and not self._place(line, tokens, i + 1):
                yield a, tokens[i + 1][1]
                i += 2
                continue
            if i + 1 < n and not self._plain(t) and (self._given(tokens[i + 1][2]) or self._initial(tokens[i + 1][2])):  # surname first
                gap, compound = line[b : tokens[i + 1][0]], COMPOUND.match(fold(t)) is not None
                listed = COMMA.match(gap) and t[:1].isupper() and tokens[i + 1][2][:1].isupper() and not self._given(t) and (not line[:a].strip() or FIELD_END.search(line, 0, a))
                if ((compound and (COMMA.match(gap) or JOIN.match(gap))) or listed) and not self._place(line, tokens, i + 1):
                    k = i + 1
                    while near(k + 1) and (self._given(tokens[k + 1][2]) or self._initial(tokens[k + 1][2])):
                        k += 1
                    # "Surname Given Surname" belongs to the given name's own surname
                    own = JOIN.match(gap) and near(k + 1) and COMPOUND.match(fold(tokens[k + 1][2]))
                    if not own and (compound or FIELD_START.match(line, tokens[k][1])):
                        yield a, tokens[k][1]
                        i = k + 1
                        continue
            i += 1

    def _may_name(self, line: str, words: list[str]) -> bool:
        """words are the line's in small letters, I as i."""
        if not self.given.isdisjoint(words) or not TITLE_WORDS.isdisjoint(words) or INITIAL.search(line):
            return True
        return "I" in line and not self.given.isdisjoint(LETTERS.findall(line.replace("İ", "i").replace("I", "ı").lower()))

    @staticmethod
    def _place(line: str, tokens: list[tuple[int, int, str]], last: int) -> bool:
        """The name belongs to a street or institution."""
        if last + 1 >= len(tokens) or not JOIN.match(line[tokens[last][1] : tokens[last + 1][0]]):
            return False
        return fold(tokens[last + 1][2]) in NOT_A_PERSON


DAY_ONE, DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # 1900 to 2099


def day_of(raw: str) -> int | None:
    """Number of a calendar day from 1900 to 2099; None for other dates."""
    m = DATE.fullmatch(raw)
    if not m:
        return None
    year, month, day = (m[1], m[2], m[3]) if m[1] else (m[7], m[6], m[4])
    try:
        n = datetime.date(int(year), int(month), int(day)).toordinal() - DAY_ONE
    except ValueError:
        return None
    return n if 0 <= n < DAYS else None


def iban_end(line: str, start: int, length: int) -> int:
    """Where the IBAN of so many letters and digits ends; 0 if the text goes on or ends before."""
    at, have = start, 0
    while have < length:
        m = IBAN_PART.match(line, at)
        if not m:
            return 0
        at, have = m.end(), have + 1
    return at if length and (at == len(line) or not line[at].isalnum()) else 0


class Pseudonyms:
    """Keyed permutations within formats; the same value always maps alike."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = key, rounds

    def _round(self, tweak: str, r: int, half: str, modulus: int) -> int:
        mac = hmac.new(self.key, f"{tweak}|{r}|{half}".encode(), hashlib.sha256).digest()
        return int.from_bytes(mac[:16], "big") % modulus

    def permute(self, value: str, tweak: str) -> str:
        """A permutation of all digit strings of the value's length (at least 2)."""
        u = len(value) // 2
        a, b = value[:u], value[u:]
        for r in range(self.rounds):
            made = (int(a or "0") + self._round(tweak, r, b, 10 ** len(a))) % 10 ** len(a)
            a, b = b, f"{made:0{len(a)}d}" if a else ""
        return a + b

    def restore(self, value: str, tweak: str) -> str:
        u = len(value) // 2
        first = u if self.rounds % 2 == 0 else len(value) - u
        a, b = value[:first], value[first:]
        for r in reversed(range(self.rounds)):
            made = (int(b or "0") - self._round(tweak, r, a, 10 ** len(b))) % 10 ** len(b)
            a, b = f"{made:0{len(b)}d}" if b else "", a
        return a + b

    @staticmethod
    def _refill(shape: str, value: str) -> str:
        it = iter(value)
        return "".join(next(it) if ch.isdigit() else ch for ch in shape)

    def tag(self, kind: str, value: str) -> str:
        return hmac.new(self.key, f"{kind}|{value}".encode(), hashlib.sha256).hexdigest()[:10]

    def of(self, kind: str, raw: str) -> str:
        d = digits(raw)
        if kind == "birth_date":
            return self._date(raw)
        if kind == "phone":
            return self._refill(raw, d[:-7] + self.permute(d[-7:], "phone"))
        if kind == "id_number":
            nine = self.permute(d[:9], "id")
            while nine[0] == "0":  # walk the cycle to the next valid number
                nine = self.permute(nine, "id")
            return self._refill(raw, nine + id_checks(nine))
        if kind == "payment_card":
            body = self.permute(d[:15], "card")
            check = next(c for c in "0123456789" if luhn(body + c) or len(set(body + c)) == 1)
            return self._refill(raw, body + check)
        if kind == "iban":
            bare = re.sub(r"[ -]", "", raw).upper()
            body = self._refill(bare[4:], self.permute(digits(bare[4:]), "iban"))
            check = 98 - iban_rest(f"{bare[:2]}00{body}")
            it = iter(f"{bare[:2]}{check:02d}{body}")
            return "".join(next(it) if ch.isalnum() else ch for ch in raw)
        same = re.sub(r"[\W_]+", " ", fold(raw)).strip()
        return self.tag(kind, same)

    def _date(self, raw: str) -> str:
        """Another calendar day in the same form."""
        made = self.permute(f"{day_of(raw):05d}", "date")
        while int(made) >= DAYS:  # walk the cycle to the next calendar day
            made = self.permute(made, "date")
        d, m = datetime.date.fromordinal(DAY_ONE + int(made)), DATE.fullmatch(raw)
        if m[1]:
            return d.isoformat()
        return f"{d.day:0{len(m[4])}d}{m[5]}{d.month:0{len(m[6])}d}{m[5]}{d.year}"

    def placeholder(self, kind: str, raw: str) -> str:
        return f"[{kind.upper()} {self.of(kind, raw)}]"


FINDINGS = "revision_id long, pii_type string, line_no long, line_start long, pseudonym string"
MASKED = "revision_id long, masked_text string, findings int"


def findings(docs: DataFrame, id_col: str = "revision_id", text_col: str = "content_text", key: bytes | None = None, given: frozenset[str] = GIVEN_NAMES) -> DataFrame:
    """One row for each finding; values appear as pseudonyms only."""
    key = key or secrets.token_bytes(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, names = Finder(given, dates=True), Pseudonyms(key)
        for batch in batches:
            rows = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for no, line in enumerate((text or "").split("\n"), 1):
                    rows += [(rid, kind, no, a + 1, names.of(kind, line[a:b])) for a, b, kind in finder.line(line)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["revision_id", "pii_type", "line_no", "line_start", "pseudonym"])

    return spread(_texts(docs, id_col, text_col)).mapInArrow(run, FINDINGS).distinct()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("revision_id"), docs[text_col].cast("string").alias("content_text"))


def masked(docs: DataFrame, id_col: str = "revision_id", text_col: str = "content_text", key: bytes | None = None, given: frozenset[str] = GIVEN_NAMES) -> DataFrame:
    """Each text with typed placeholders in place of its findings.

    Redelivered rows are told by their id and text before any text is masked;
    rows without id all stay.
    """
    key = key or secrets.token_bytes(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, names = Finder(given, dates=True), Pseudonyms(key)
        for batch in batches:
            out, counts = [], []
            for text in batch.column(1).to_pylist():
                n, lines = 0, []
                for line in (text or "").split("\n"):
                    at, parts = 0, []
                    for a, b, kind in finder.line(line):
                        parts += [line[at:a], names.placeholder(kind, line[a:b])]
                        at, n = b, n + 1
                    lines.append("".join(parts) + line[at:])
                out.append(None if text is None else "\n".join(lines))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=["revision_id", "masked_text", "findings"])

    apart = F.when(F.col("revision_id").isNull(), F.monotonically_increasing_id())
    rows = _texts(docs, id_col, text_col).withColumn("_row", apart).withColumn("_same", F.xxhash64("content_text"))
    once = rows.dropDuplicates(["revision_id", "_row", "_same", "content_text"]).select("revision_id", "content_text")
    return spread(once).mapInArrow(run, MASKED)


def found_lines(docs: DataFrame, id_col: str = "revision_id", text_col: str = "content_text", given: frozenset[str] = GIVEN_NAMES) -> DataFrame:
    """(revision_id, pii_type, line_no) of the seven types, once each; no pseudonym is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(given)
        for batch in batches:
            rows = {(rid, kind, no) for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for no, line in enumerate((text or "").split("\n"), 1) for _, _, kind in finder.line(line)}
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["revision_id", "pii_type", "line_no"])

    rows = _texts(docs, id_col, text_col).where("revision_id is not null and content_text is not null")
    return spread(rows).mapInArrow(run, "revision_id long, pii_type string, line_no long").distinct()
