"""Problem 3: defective question and answer pairs.

empty and copied come from the texts' own form. refusal compares the
likelihood of each clause under models of declining and of courteous clauses,
counted from exemplars that are put together of parts in four languages, with
its likelihood under all answers; an answer that declines and says nothing
else refuses. wrong_language compares the language posteriors of question and
answer under a character trigram naive Bayes fitted on all questions with
their (partly wrong) labels. truncated compares the likelihood that a text
ends where the answer does, under a back-off n-gram model of what precedes
sentence ends, counted over all answers by 64-bit keys. The counts stay
distributed: they are joined to the last contexts of the answers whose form
leaves the end open.

A pair has at most one defect, the first of DEFECTS that holds. Defined
results: a null question never makes copied or wrong_language; texts without
letters have no language; an assistant message before any user message is
checked with a null question; redelivered records give one row; a null record
id gives no row in the findings.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import ngram
from sievewright.llm.quality import FUNCTION_WORDS
from sievewright.tables import spread, written

DEFECTS = ("empty", "copied", "refusal", "wrong_language", "truncated")

#: Words that alone, or with others of them, say nothing; PARTS only along with one of these.
FILLERS = frozenset("none null nil nan na n/a yok boş bos cevap cevabınız answer antwort réponse reponse response output todo tbd fixme xxx ... lorem ipsum undefined empty leer vide keine aucune bilmiyorum".split())
PARTS = frozenset("no not the there is keine kein bir henüz yet available verilmedi belirtilmedi pas de provided given yoktur".split())
LABEL = re.compile(r"^\W*(?:soru|cevap|yanıt|question|answer|frage|antwort|réponse|q|a|s|c|prompt|response|user|assistant|kullanıcı)\s*[:：]\s*", re.I)
SENTENCES = re.compile(r"(?<=[.!?…])[\"”’»“)]*\s+|\n+")
WORD = re.compile(r"[^\W_]+")
FILLER_WORD = re.compile(r"[^\W_]+(?:/[^\W_]+)*")

#: Clauses that decline and courteous ones around them, put together of alternatives from left to right.
DECLINING = {
    "tr": (
        (
            "üzgünüm ama|maalesef|ne yazık ki|kusura bakmayın|bir yapay zekâ olarak|kurallarım gereği|",
            "bu soruya|bu soruyu|bu konuda|bu talebe|bu isteğe|bu isteğinizi|böyle bir şeyi|bunu|size",
            "yanıt veremem|cevap veremiyorum|cevap vermeyeceğim|yanıt vermek istemiyorum|yanıtlayamam|cevaplayamıyorum|yardımcı olamam|yardım edemem|bilgi veremem|bilgi vermem uygun değil|yapamam|yerine getiremem"
            "|karşılayamam|karşılamam mümkün değil|reddediyorum|reddetmek zorundayım|yapmam söz konusu değil|anlatmayı tercih etmem|konuşamam|üretemem|yapmama izin yok",
        ),
    ),
    "en": (
        (
            "i'm sorry but|sorry|unfortunately|as an ai model|",
            "i cannot|i can't|i am not able to|i'm unable to|i won't|i will not|i refuse to|i must decline to|i have to decline to|i am not allowed to|i am not permitted to|i would rather not|i'd rather not|i do not want to|i don't feel comfortable to",
            "answer that|answer this question|help with that|help you with this|assist with this request|respond|respond to this request|discuss this topic|talk about that|talk about the topic|provide that information|give information on this|do that|comment on this|share this|fulfil your request",
        ),
        ("i'm sorry but|unfortunately|", "this request|this question|that|this topic", "is something i cannot answer|is not something i can help with|goes against my guidelines|is not allowed|must be declined|is beyond what i may discuss"),
        ("my guidelines|my rules|my instructions", "prevent me from|keep me from|do not allow me to|forbid me to", "answering|helping|discussing this|answer|help you|discuss this topic"),
    ),
    "de": (
        (
            "es tut mir leid|leider|entschuldigung|als ki modell|",
            "kann ich|darf ich|möchte ich|werde ich|will ich",
            "diese frage|dazu|dabei|diese anfrage|zu diesem thema|darauf|ihnen dabei|das",
            "nicht beantworten|keine auskunft geben|nicht helfen|nicht bearbeiten|nichts sagen|nicht antworten|nicht äußern|nicht weiterhelfen|nicht erfüllen|nicht sprechen",
        ),
        ("es tut mir leid|leider|", "diese anfrage|diese frage|das|die antwort", "muss ich ablehnen|lehne ich ab|ist mir nicht erlaubt|ist mir nicht gestattet|ist mir nicht möglich|ist mir untersagt|verstößt gegen meine regeln"),
    ),
    "fr": (
        (
            "désolé|je suis désolé mais|malheureusement|en tant que modèle|",
            "je ne peux pas|je ne suis pas en mesure de|je refuse de|je ne souhaite pas|je préfère ne pas|je ne suis pas autorisé à|je dois refuser de|il m'est impossible de|il m'est interdit de|mes règles m'interdisent de",
            "répondre à cette question|vous aider|traiter cette demande|parler de ce sujet|répondre|donner cette information|faire cela|fournir ce contenu|discuter de cela",
        ),
        ("désolé|malheureusement|", "je dois refuser|je refuse|je décline|je ne peux accepter", "cette demande|votre demande|cette question|"),
    ),
}
COURTEOUS = {
    "tr": (
        ("lütfen|dilerseniz|isterseniz|", "başka bir soru sorun|başka bir konuda yardımcı olabilirim|bir uzmana danışın|bir uzmana danışmanızı öneririm|bir hekime başvurun|başka bir konu seçin"),
        ("anlayışınız için|ilginiz için|sorunuz için|", "teşekkürler|teşekkür ederim|sağ olun"),
    ),
    "en": (
        ("please|feel free to|you may|is there|", "ask another question|consult a professional|ask an expert|something else you would like to discuss|anything else i can help with|contact a specialist|choose another topic"),
        ("thank you for|thanks for|i understand", "your understanding|asking|the question"),
    ),
    "de": (
        ("bitte|gern können sie|gibt es", "stellen sie eine andere frage|wenden sie sich an eine fachperson|etwas anderes fragen|fragen sie einen fachmann|etwas anderes wobei ich helfen kann"),
        ("danke für|vielen dank für|ich verstehe", "die frage|ihr verständnis|die anfrage"),
    ),
    "fr": (
        ("veuillez|vous pouvez|n'hésitez pas à|puis je", "poser une autre question|consulter un spécialiste|demander à un professionnel|choisir un autre sujet|vous aider autrement"),
        ("merci de|merci pour|je vous remercie de|je comprends", "votre compréhension|votre question|votre confiance"),
    ),
}
ASKS_FOR_REFUSAL = re.compile(r"\bret cümle|\breddetme|\bretme örne|refusal|declin(?:e|ing) politely|absage|ablehnung|\brefus\b", re.I)
TRANSLATION_ASKED = re.compile(r"(?:ye|ya|çe|ca|ce|cesine|ceye|caya)\s+çevir|tercüme et|translate\b[^.]*\b(?:to|into)\b|übersetze?n?\b[^.]*\b(?:ins|auf|in)\b|tradui\w*[^.]*\ben\b|in (?:english|german|french|turkish)\b|auf (?:deutsch|englisch|türkisch|französisch)\b|en (?:anglais|allemand|turc|français)\b", re.I)
CODE = re.compile(r"```.*?```|`[^`]*`|https?://\S+|<[^>]{1,40}>", re.S)
ITEM = re.compile(r"^\s*(?:[-–—•*→·]|\(?\d{1,3}[.)])\s*")
OPEN_NUMBER = re.compile(r"(?:^|\n)\s*\(?\d{1,3}[.)]\s*\W{0,2}$")

WHOLE, UNSEEN = 1, 0.1  # a last word never seen whole is likelier a part of one
LEAST_MARGIN = 12.0  # log-likelihood by which another language must win
LEAST_LETTERS = 8
ENDS = 0.2  # an answer is cut if fewer of its last words' occurrences end a sentence


def fold(text: str) -> str:
    return text.replace("İ", "i").replace("I", "i").replace("ı", "i").lower()


def normal(text: str) -> list[str]:
    return WORD.findall(fold(text))


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if len(answer) > 60:  # longer than any filler
        return WORD.search(answer) is None
    words = FILLER_WORD.findall(answer.replace("İ", "i").lower())
    if not words or "".join(words) in FILLERS:
        return True
    return len(words) <= 4 and not FILLERS.isdisjoint(words) and (FILLERS | PARTS).issuperset(words)


LABELS = frozenset(("soru", "question", "frage", "cevap", "answer", "antwort", "yanit", "réponse"))


def is_copied(question: str | None, answer: str) -> bool:
    if not question:
        return False
    body = LABEL.sub("", answer)
    first = WORD.search(body)
    if first and fold(first[0]) not in fold(question) and fold(first[0]) not in LABELS:
        return False
    said = normal(body)
    every = set(normal(question))
    if not (every | LABELS).issuperset(said):  # a word that the question lacks
        return False
    sentences = [x for x in SENTENCES.split(question.strip()) if normal(x)]
    wholes = [normal(question)] + [normal(" ".join(sentences[k:])) for k in range(1, len(sentences))]
    for asked in wholes:
        n = len(asked)
        if not n or len(said) < n:
            continue
        at, end = 0, len(said)
        while at < end:
            while at < end and said[at : at + n] != asked and said[at] in LABELS:
                at += 1
            if said[at : at + n] != asked:
                break
            at += n
        rest = said[at:]
        if not rest or all(w in LABELS for w in rest) or (at and rest == asked[: len(rest)]):
            return True
    return False


def clause_features(words: list[str]) -> list[str]:
    """Words, their beginnings and endings, and neighbouring pairs."""
    out = []
    for a, b in zip(words, [*words[1:], ""], strict=False):
        out.append(a)
        if len(a) > 5:
            out.append("^" + a[:5])
        if len(a) > 4:
            out.append("$" + a[-4:])
        if b:
            out.append(a + " " + b)
    return out


@functools.cache
def exemplar_rates(name: str, lang: str) -> dict[str, float]:
    """How often a feature occurs in a clause of a language's exemplars, each form of clause alike."""
    forms, rates = {"declining": DECLINING, "courteous": COURTEOUS}[name][lang], {}
    for form in forms:
        clauses = [" ".join(filter(None, parts)) for parts in itertools.product(*(part.split("|") for part in form))]
        for clause in clauses:
            for f in set(clause_features(normal(clause))):
                rates[f] = rates.get(f, 0.0) + 1 / len(clauses) / len(forms)
    return rates


MODELS = tuple((name, lang) for name in ("declining", "courteous") for lang in DECLINING)


class Refusals:
    """Log-likelihood ratios of clauses: declining or courteous in any language, against all answers of that language.

    background has for each language how often its answers hold each feature of
    the exemplars, and the number of their clauses under "".
    """

    CLAUSE = re.compile(r"(?<=[.!?…])[\"”’»“)]*\s+|\n+|[;:]\s+")
    UNKNOWN = -1.5  # a word of no exemplar
    LEAST = 10.0  # what a clause must score
    PRIOR = 1000  # clauses that are supposed before any are counted, a tenth of them with a given function word

    def __init__(self, background: dict[str, dict[str, int]]):
        expected = lambda lang, f: self.PRIOR * (0.1 if f in FUNCTION_WORDS[lang] else 0.001)
        share = lambda lang, f: (background.get(lang, {}).get(f, 0) + expected(lang, f)) / (background.get(lang, {}).get("", 0) + self.PRIOR)
        ratio = {m: {f: float(np.log((r + 1e-4) / (share(m[1], f) + 1e-4))) for f, r in exemplar_rates(*m).items()} for m in MODELS}
        self.table: dict[str, np.ndarray] = {}  # of each feature the ratio in each model
        for i, m in enumerate(MODELS):
            for f, r in ratio[m].items():
                self.table.setdefault(f, np.zeros(len(MODELS)))[i] = r
        core = {f for m, known in ratio.items() if m[0] == "declining" for f, r in known.items() if f[0] not in "^$" and " " not in f and r > 2.5}
        self.core = np.sort(Tokens(sorted(core)).whole)

    def may_decline(self, answers: list[str]) -> np.ndarray:
        """Which answers hold a word that is much likelier in declining clauses; without one none scores enough."""
        tokens = Tokens(answers)
        out = np.zeros(len(answers), bool)
        out[tokens.text_of[np.isin(tokens.whole, self.core)]] = True
        return out

    def score(self, words: list[str]) -> tuple[float, float]:
        """How a clause scores as declining and as courteous, in the language that suits it best."""
        total = np.full(len(MODELS), self.UNKNOWN * len(words))
        for f in set(clause_features(words)):
            if (r := self.table.get(f)) is not None:
                total += r
        for w in words:
            a, b = self.table.get(w), self.table.get("^" + w[:5])
            if a is not None or b is not None:
                total -= self.UNKNOWN * ((0 if a is None else a != 0) | (0 if b is None else b != 0))
        half = len(MODELS) // 2
        return float(total[:half].max()), float(total[half:].max())

    def refuses(self, question: str | None, answer: str) -> bool:
        flat = answer.replace("’", "'")
        if question and ASKS_FOR_REFUSAL.search(question):
            return False
        declines, answered = False, 0
        for clause in self.CLAUSE.split(flat):
            words = normal(clause)
            if not words:
                continue
            quoted = clause.lstrip()[:1] in "“„«\""
            declining, courteous = self.score(words)
            if not quoted and declining >= self.LEAST and declining >= courteous:
                declines = True
            elif courteous < self.LEAST and len(words) >= 4:
                answered += 1
        return declines and not answered


def letters_of(text: str | None) -> str:
    if not text:
        return ""
    return CODE.sub(" ", text) if "`" in text or "://" in text or "<" in text else text


class Languages:
    """Naive Bayes over character trigrams."""

    def __init__(self, log_joint: np.ndarray):
        self.log_joint = log_joint

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood under each language and number of letters of each text."""
        c = ngram.codes("\n" + "\n".join([*texts, ""]))
        text_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        mid, left, right = c[1:-1], c[:-2], c[2:]
        at = np.flatnonzero((mid > 0) & ((left > 0) | (right > 0)))
        tri = (left[at] * ngram.BASE + mid[at]) * ngram.BASE + right[at]
        out = np.stack([np.bincount(text_of[at], weights=row[tri], minlength=len(texts)) for row in self.log_joint], axis=1)
        return out, np.bincount(text_of[np.flatnonzero(mid > 0)], minlength=len(texts))

    def differ(self, questions: list[str | None], answers: list[str]) -> list[bool]:
        if not answers:
            return []
        plain = []
        for said in map(letters_of, answers):
            words = said.split(None, 4)
            plain.append(said if len(words) > 3 else " ".join(w for w in words if not w[:1].isupper()))  # less bare names
        q, asked = self.scores([letters_of(x) for x in questions])
        a, said = self.scores(plain)
        mine, rows = q.argmax(axis=1), np.arange(len(q))
        second = np.partition(q, -2, axis=1)[:, -2]
        other = (a.argmax(axis=1) != mine) & (a.max(axis=1) - a[rows, mine] > LEAST_MARGIN) & (q[rows, mine] - second > 3)
        other &= (asked >= LEAST_LETTERS) & (said >= LEAST_LETTERS)
        return [bool(o) and bool(x) and not TRANSLATION_ASKED.search(x) for o, x in zip(other, questions, strict=True)]


STOPS = ".!?…"
ORDER = 5  # contexts of a token
LEAST_SEEN = 3  # rarer contexts say nothing
CHARS_AT_ONCE = 1 << 22
WANTED_BITS = 1 << 22
_Q = 0x9E3779B97F4A7C15


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> 0 space, 1 letter, 2 digit, 3 other; small letter."""
    kind, low = np.full(0x110000, 3, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x34000):
        ch = chr(cp)
        if ch.isspace() or ch == "_":
            kind[cp] = 0
        elif ch.isdecimal():
            kind[cp] = 2
        elif ch.isalnum():
            kind[cp] = 1
            low[cp] = ord(fold(ch)[0])
    return kind, low


_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _Q, np.uint64)])
    return _POWERS[0][:n]


class Tokens:
    """Words, numbers and single signs of some texts as hashes: whole, by ending, and by place in a frame, where punctuation and short words stay whole."""

    def __init__(self, texts: list[str]):
        kinds, low = _characters()
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.r_[0, np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))]
        k = kinds[codes]
        digit = k == 2
        k[1:-1][((codes[1:-1] == ord(".")) | (codes[1:-1] == ord(","))) & digit[:-2] & digit[2:]] = 2  # marks inside a number
        before = np.r_[np.uint8(0), k[:-1]]
        start = np.flatnonzero((k > 0) & ((k == 3) | (k != before)))
        kind = k[start]
        after = np.r_[k[1:], np.uint8(0)]
        end = np.flatnonzero((k > 0) & ((k == 3) | (k != after))) + 1
        size = end - start
        small = low[codes].astype(np.uint64)
        if len(start):
            offset = np.arange(len(codes)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(codes)]))
            inside = k == 1
            q = _powers(int(size[kind == 1].max(initial=0)) + 1)
            whole = np.add.reduceat(np.where(inside, small * q[np.where(inside, offset, 0)], np.uint64(0)), start)
        else:
            whole = np.empty(0, np.uint64)
        whole[kind == 2] = 1
        whole[kind == 3] = small[start[kind == 3]] * np.uint64(_Q) + np.uint64(7)
        self.letters = kind == 1
        if len(start):
            begun = inside & (offset < 5)
            begin = np.add.reduceat(np.where(begun, small * q[np.where(begun, offset, 0)], np.uint64(0)), start) if len(q) else whole
        else:
            begin = whole
        last = lambda n: sum(small[np.maximum(end - d, 0)] * _powers(8)[d] for d in range(1, n + 1))
        self.ending = np.where((kind == 1) & (size > 3), last(3) ^ np.uint64(0x5555), whole)
        self.frame = np.where((kind == 1) & (size > 4), np.uint64(3), whole)
        self.begin, self.tail, self.size = begin ^ np.uint64(0x3333), last(4) ^ np.uint64(0x7777), size  # of words of more than five, or four, letters
        self.apostrophe = (kind == 3) & np.isin(codes[start], (ord("'"), ord("’")))
        self.whole = whole
        self.text_of = np.searchsorted(first, start, "right") - 1
        self.stop = (kind == 3) & np.isin(codes[start], [ord(c) for c in STOPS])

    def features(self) -> np.ndarray:
        """Hashes of all clause_features: words, their beginnings and endings, and neighbouring pairs."""
        w = self.letters
        row = np.flatnonzero(~self.apostrophe)
        pair = self.letters[row[:-1]] & self.letters[row[1:]] & (self.text_of[row[:-1]] == self.text_of[row[1:]]) if len(row) else np.zeros(0, bool)
        a, b = (self.whole[row[:-1][pair]], self.whole[row[1:][pair]]) if len(row) else (self.whole, self.whole)
        return np.concatenate([self.whole[w], self.begin[w & (self.size > 5)], self.tail[w & (self.size > 4)], (a * np.uint64(_Q)) ^ (b + np.uint64(0x1111))])

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """Keys of the contexts up to and including the tokens at, from general to special: its ending,
        the word itself, then its ending after the frames of two, four and seven tokens."""

        def key(h: np.ndarray, level: int) -> np.ndarray:
            h = (h ^ np.uint64(level)) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            return (h ^ (h >> np.uint64(32))).view(np.int64)

        keys, h = [key(self.ending[at], 0), key(self.whole[at], 1)], self.ending[at].copy()
        for d in range(1, 8):
            from_ = np.maximum(at - d, 0)
            h = h * np.uint64(_Q) + np.where((at >= d) & (self.text_of[from_] == self.text_of[at]), self.frame[from_], np.uint64(0))
            if d in (2, 4, 7):
                keys.append(key(h, d))
        return np.stack(keys, axis=1) if len(at) else np.empty((0, ORDER), np.int64)


def parts_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(from, to) of the texts that are counted together."""
    ends, at = np.cumsum([len(t) for t in texts]), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS_AT_ONCE, "right")))
        yield at, to
        at = to


def fit_ends(answers: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(context, n, ends): how often each context was seen and ended a sentence, over all answers.

    Of the contexts wanted, if given, only the lowest bits go to the workers,
    half a megabyte at any size: other contexts with other bits are left out
    before they are counted, which changes no count of a wanted one.
    """
    marks = None
    if wanted is not None:
        bits = wanted.select(F.explode("contexts").alias("c")).select(F.col("c").bitwiseAND(F.lit(WANTED_BITS - 1)).alias("b")).distinct().toPandas()["b"]
        held = np.zeros(WANTED_BITS, bool)
        held[bits.to_numpy(dtype=np.int64)] = True
        marks = answers.sparkSession.sparkContext.broadcast(np.packbits(held))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if marks is None else np.unpackbits(marks.value).view(bool)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in parts_of(texts):
                tokens = Tokens(texts[a:b])
                at = np.arange(max(len(tokens.whole) - 1, 0))
                at = at[(tokens.text_of[:-1] == tokens.text_of[1:]) & ~tokens.stop[:-1]] if len(at) else at
                keys, end = tokens.contexts(at).reshape(-1), np.repeat(tokens.stop[at + 1], ORDER)
                if known is not None:
                    some = known[keys & (WANTED_BITS - 1)]
                    keys, end = keys[some], end[some]
                keys, where = np.unique(keys, return_inverse=True)
                ends, n = np.bincount(where, weights=end, minlength=len(keys)), np.bincount(where, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(ends.astype(np.int64))], names=["context", "n", "ends"])

    rows = spread(answers).mapInArrow(count, "context long, n long, ends long")
    return rows.groupBy("context").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).where(F.col("n") >= LEAST_SEEN)


def end_rate(counts: Iterable[tuple[int, int]], prior: float = 0.05, weight: float = 2.0) -> float:
    """Likelihood of an end by the (seen, ended) counts of the contexts, from general to special."""
    p = prior
    for k, (n, ends) in enumerate(counts):
        if k == WHOLE and n < LEAST_SEEN:
            p *= UNSEEN
        if n < LEAST_SEEN:
            continue
        p = (ends + weight * p) / (n + weight)
    return float(p)


def open_end(answer: str) -> bool | str:
    """Whether the answer's form shows that it is cut; its text where the form leaves that open."""
    text = CODE.sub(" ", answer) if "`" in answer and answer.count("`") % 2 == 0 or "://" in answer or "<" in answer else answer
    while text != (bare := text.rstrip().rstrip("*_~\u200b")):
        text = bare
    if not text:
        return False
    if OPEN_NUMBER.search(text, max(0, len(text) - 60)):
        return True
    last = text.rstrip("\"”’»“)]' ")
    if not last or last[-1] in STOPS:
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    entry = ITEM.sub("", lines[-1])
    if len(WORD.findall(entry)) <= 3 and text[-1] not in ",;(" and (len(lines) > 1 or len(WORD.findall(text)) <= 2):
        others = [ITEM.sub("", x) for x in lines[:-1]]
        if all(len(WORD.findall(x)) <= 5 for x in others):
            return False
    return True if text[-1] in ",;:(–-/" else text


SCHEMA = "record_id string, answer_pos long, defect string"


def contribution_pairs(contributions: DataFrame, id_col: str = "contribution_id", question_col: str = "input_text", answer_col: str = "output_text", lang_col: str = "item_language") -> DataFrame:
    return contributions.select(
        contributions[id_col].cast("string").alias("record_id"),
        F.lit(0).cast("long").alias("answer_pos"),
        contributions[question_col].alias("question"),
        contributions[answer_col].alias("answer"),
        contributions[lang_col].alias("lang"),
    )


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """Each answer with the nearest user message before it."""
    paired = F.expr(
        """filter(transform(messages, (m, i) -> struct(
               cast(i as bigint) as answer_pos,
               m.message_role = 'assistant' and m.tool_call_id is null as is_answer,
               try_element_at(filter(slice(messages, 1, i), x -> x.message_role = 'user'), -1).content_text as question,
               m.content_text as answer)), p -> p.is_answer)"""
    )
    return conversations.select(F.col("sample_id").cast("string").alias("record_id"), F.explode(paired).alias("p"), F.col("item_language").alias("lang")).select(
        "record_id", "p.answer_pos", "p.question", "p.answer", "lang"
    )


def feature_hash(f: str) -> int:
    """Of a feature of clause_features its hash among those of Tokens."""
    if f[0] in "^$":
        tokens = Tokens([f[1:]])
        return int((tokens.begin if f[0] == "^" else tokens.tail)[0])
    return int(Tokens([f]).features()[-1 if " " in f else 0])


def fit_models(pairs: DataFrame) -> tuple[np.ndarray, dict[str, dict[str, int]]]:
    """Trigram counts of the questions by language, and by language how often the answers hold each feature of the exemplars.

    One pass; what reaches the driver is bounded by the alphabet and by the exemplars.
    """
    langs = ngram.LANGUAGES
    features = {lang: sorted(exemplar_rates("declining", lang).keys() | exemplar_rates("courteous", lang).keys()) for lang in langs}
    starts = np.cumsum([ngram.SIZE * len(langs), *(len(features[lang]) + 1 for lang in langs)])  # trigrams, then each language's features and number of clauses

    keys = {lang: np.array([feature_hash(f) for f in features[lang]], np.uint64) for lang in langs}
    order = {lang: np.argsort(k) for lang, k in keys.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(starts[-1], np.int64)
        for batch in batches:
            labels, questions, answers = (batch.column(i).to_pylist() for i in range(3))
            for i, lang in enumerate(langs):
                own = [j for j, x in enumerate(labels) if x == lang]
                asked = "\n".join(questions[j] for j in own if questions[j])
                if asked:
                    seen[i * ngram.SIZE : (i + 1) * ngram.SIZE] += np.bincount(ngram.trigrams(asked), minlength=ngram.SIZE)
                said, part = [answers[j] for j in own if answers[j]], seen[starts[i] : starts[i + 1]]
                for a, b in parts_of(said):
                    tokens = Tokens(said[a:b])
                    part[-1] += b - a + int(tokens.stop[:-1].sum())  # an answer's last stop ends its last clause
                    known, made = keys[lang][order[lang]], tokens.features()
                    at = np.minimum(np.searchsorted(known, made), len(known) - 1)
                    part[:-1] += np.bincount(order[lang][at[known[at] == made]], minlength=len(known))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], names=["k", "n"])

    primary = F.lower(F.regexp_extract(F.trim("lang"), r"^([A-Za-z]+)", 1))
    got = spread(pairs.select(primary.alias("lang"), "question", "answer")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(starts[-1])
    flat[got["k"].to_numpy(dtype=np.int64)] = got["n"]
    background = {lang: dict(zip([*features[lang], ""], flat[starts[i] : starts[i + 1]].astype(np.int64).tolist(), strict=True)) for i, lang in enumerate(langs)}
    return flat[: starts[0]].reshape(-1, ngram.SIZE), background


def judged(questions: list[str | None], answers: list[str | None], languages: Languages, refusals: Refusals) -> list[tuple[str | None, list[int] | None]]:
    """Of each pair its defect, or the contexts of its last word where only the likelihood of an end can tell."""
    out: list[tuple[str | None, list[int] | None]] = []
    may = refusals.may_decline([a or "" for a in answers])
    for q, a, m in zip(questions, answers, may, strict=True):
        out.append(("empty" if is_empty(a) else "copied" if is_copied(q, a) else "refusal" if m and refusals.refuses(q, a) else None, None))
    rest = [i for i, (defect, _) in enumerate(out) if not defect]
    ends = []
    for i, wrong in zip(rest, languages.differ([questions[i] for i in rest], [answers[i] for i in rest]), strict=True):
        end = False if wrong else open_end(answers[i])
        if wrong or end is True:
            out[i] = ("wrong_language" if wrong else "truncated", None)
        elif end:
            ends.append((i, end))
    if ends:
        tokens = Tokens([end for _, end in ends])
        final = np.searchsorted(tokens.text_of, np.arange(len(ends)), "right") - 1
        some = np.flatnonzero((final >= 0) & (tokens.text_of[np.maximum(final, 0)] == np.arange(len(ends)))) if len(tokens.text_of) else []
        for k, keys in zip(some, tokens.contexts(final[some]).tolist() if len(some) else [], strict=True):
            out[ends[k][0]] = (None, keys)
    return out


def defective(pairs: DataFrame) -> DataFrame:
    """(record_id, answer_pos, defect) of the defective pairs."""
    counts, background = fit_models(pairs)
    shared = pairs.sparkSession.sparkContext.broadcast((Languages(ngram.log_joint(counts)), Refusals(background)))  # 4 MB at any input size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, refusals = shared.value
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            questions, answers = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            made = judged(questions, answers, languages, refusals)
            kept = [i for i, (defect, last) in enumerate(made) if defect or last]
            at = pa.array(kept, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array([made[i][0] for i in kept], pa.string()), pa.array([made[i][1] for i in kept], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["record_id", "answer_pos", "defect", "contexts"])

    rows = spread(pairs.select("record_id", "answer_pos", "question", "answer")).mapInArrow(run, SCHEMA + ", contexts array<long>").distinct()
    rows = written(rows, "pairs")  # both parts below are read from it
    clear = rows.where("defect is not null").select("record_id", "answer_pos", "defect")
    open_ends = rows.where("defect is null")
    return clear.unionByName(cut_ends(open_ends, fit_ends(pairs.select("answer"), open_ends))).distinct()


def cut_ends(answers: DataFrame, ends: DataFrame) -> DataFrame:
    """The answers (record_id, answer_pos, contexts) whose last contexts rarely end a sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [end_rate((c["n"], c["ends"]) for c in counts) < ENDS for counts in batch.column(2).to_pylist()]
            kept = batch.filter(pa.array(cut, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(["truncated"] * kept.num_rows, pa.string())], names=["record_id", "answer_pos", "defect"])

    each = answers.select("record_id", "answer_pos", "contexts", F.posexplode("contexts").alias("k", "context"))
    counts = F.struct("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ends", F.lit(0)).alias("ends"))
    rows = each.join(ends, "context", "left").groupBy("record_id", "answer_pos", "contexts").agg(F.sort_array(F.collect_list(counts)).alias("counts"))
    return rows.select("record_id", "answer_pos", "counts").mapInArrow(run, SCHEMA)
