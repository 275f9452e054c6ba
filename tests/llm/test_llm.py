"""Small defined cases, brute force and round trips of the training-data operators."""

import os
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm import bpe, budget, format_dedup, leak, mixing, mojibake, ngram, pairs, pii, quality

VOCABULARY = os.path.exists(bpe.VOCABULARY)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc_domain string, extra string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# 2


def brute_pairs(records):
    groups = defaultdict(list)
    for rid, key in zip((r[0] for r in records), format_dedup.canonical_keys([r[1] for r in records]), strict=True):
        if key is not None:
            groups[key].append(rid)
    return sorted((min(g), x) for g in groups.values() for x in g if x != min(g))


def test_format_forms():
    same = ['{"a": "İ x", "b": "1"}', ' {"b":"1.","a":"ix"} ', '{"a":"\\u0130  X!","b":"1"}']
    assert len(set(format_dedup.canonical_keys(same))) == 1
    apart = ['{"a":"x"}', "a=x", "x", '{"b":"x"}', '{"a":null}', '{"a":""}']
    assert len(set(format_dedup.canonical_keys(apart))) == len(apart)
    assert format_dedup.canonical_keys(['{"a": "cut', None]) == [None, None]
    assert len(set(format_dedup.canonical_keys(["a=1\tb=Xy", "b=x-y\ta=1"]))) == 1
    assert len(set(format_dedup.canonical_keys(["STRASSE", "Straße"]))) == 1


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_fold_ignores_what_it_should(s):
    folded = format_dedup.folded([s])[0]
    assert not any(ch.isspace() or unicodedata.category(ch)[0] in "PZ" for ch in folded)
    assert format_dedup.folded([s + " .,\t"])[0] == folded


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_copies_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    records = [(i, "hot text" if i % 3 == 0 else rng.choice(["A b", "a  B.", "k=v", "K", '{"t":"x"}', '{"t":"X"}', '{"t"', " ", None])) for i in range(900)]
    df = spark.createDataFrame(records, "record_id long, raw_line string")
    assert rows(format_dedup.copy_pairs(df, partitions=partitions)) == brute_pairs(records)
    counts = {r["first_record_id"]: r["copies"] for r in format_dedup.representatives(df, partitions=partitions).collect()}
    assert sum(counts.values()) == sum(k is not None for k in format_dedup.canonical_keys([r[1] for r in records]))
    lines = dict(records)
    assert all(r["record"] == lines[r["first_record_id"]] for r in format_dedup.representatives(df, partitions=partitions).collect())


@pytest.mark.parametrize("partitions", [1, 4])
def test_copies_without_id_are_counted(spark, partitions):
    records = [(7, "Ab"), (None, "a b"), (None, "AB."), (None, "only"), (None, "ONLY"), (3, "x"), (None, None), (None, '{"cut')]
    df = spark.createDataFrame(records * 3, "record_id long, raw_line string")
    got = sorted((str(r["first_record_id"]), r["copies"], format_dedup.canonical_keys([r["record"]])[0]) for r in format_dedup.representatives(df, partitions=partitions).collect())
    key = lambda x: format_dedup.canonical_keys([x])[0]
    assert got == sorted([("7", 9, key("ab")), ("None", 6, key("only")), ("3", 3, key("x"))])
    assert rows(format_dedup.copy_pairs(df, partitions=partitions)) == []


def test_copies_of_nothing(spark):
    empty = spark.createDataFrame([], "record_id long, raw_line string, h long, key string")
    assert rows(format_dedup.copy_pairs(empty)) == []
    odd = spark.createDataFrame([(None, "a", 1, "x"), (4, "a", 1, "y"), (5, "A", 2, None)], "record_id long, raw_line string, h long, key string")
    assert rows(format_dedup.copy_pairs(odd)) == [(4, 5)]


# 1


PROSE = "Her kaynak gibi bu sunucu, tutarsız dizinlerin içinde anlam kazandı. Yazar ve okur için yeni bir yol açıldı, ama kimse bunu bilmiyordu."


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE, "prose"),
        ("Başlık\n" + PROSE + "\n- bir madde\nTel: 0594 991 90 65", "prose"),
        ("\n".join(PROSE.split(". ")[0].split()), "prose"),
        ("\n".join(f"{i}) Kavram yöntem" for i in range(9)), "list"),
        ("\n".join(f"sayfa;{1990 + i};33,42;Toytoy" for i in range(9)), "table"),
        ("\n".join(f"ölçüt: {i * 37} mm" for i in range(9)), "table"),
        ("#$%^&*@!~<>?+=" * 12, "junk"),
        ("veri " * 60, "junk"),
        ("rwjj gbcv dvgd dxwfm vmmgh sffv wvkwn jmsnr fxglv", "junk"),
        ("", None),
        (" \n\t", None),
    ],
)
def test_kinds(text, kind):
    c = quality.Counted([PROSE, text, PROSE])
    got = quality.kinds(c.counts, c.mass, c.text_of_segment, 3, quality.smoothed(quality.seeds()))
    assert got == ["prose", kind, "prose"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_counts_against_plain_ones(texts):
    c = quality.Counted(texts)
    for i, text in enumerate(texts):
        seen = [ch for ch in text if not ch.isspace()]
        assert c.visible[i] == len(seen)
        assert c.parts[i] == len(re.findall(r"[^\W_]+", text))
        assert c.words[i] == len(re.findall(r"[^\W_]+(?:['’][^\W_]+)*", text))
    assert c.mass.sum() == c.visible.sum() and len(c.text_of_segment) == c.segments


def test_divergence_is_symmetric_and_zero_at_home():
    p = quality.smoothed(quality.seeds())
    d = quality.divergence(p, p)
    assert abs(np.diag(d)).max() < 1e-9 and abs(d - d.T).max() < 1e-9 and d.min() > -1e-9


def test_texts_counted_apart_or_together():
    texts = [PROSE, "", "a\tb\t1\nc\td\t2", "veri " * 30, "x"]
    whole = quality.Counted(texts)
    for i, text in enumerate(texts):
        alone = quality.Counted([text])
        own = whole.text_of_segment == i
        assert (whole.counts[own] == alone.counts).all() and whole.words[i] == alone.words[0]


def test_profiles_are_counted_from_the_corpus(spark):
    d = spark.createDataFrame([(i, "Cümle ve sözcük için yeni bir yol vardır, ama kimse bilmez. " * 3) for i in range(9)], "revision_id long, content_text string")
    counted = d.selectExpr("revision_id", "0L a", "0L b", "content_text").mapInArrow(quality._count, quality.COUNTED)
    moved = abs(quality.fitted(counted) - quality.smoothed(quality.seeds())).sum(axis=1)
    assert moved[[k == "prose" for k, _ in quality.EXEMPLARS]].max() > 0.1


def test_statistics_rows(spark):
    d = spark.createDataFrame([(1, PROSE, 5, None, "x"), (1, PROSE, 5, None, "x"), (2, None, None, 3, "y"), (None, "# " * 90, 1, 1, "z"), (3, "veri " * 40000, 0, 0, "")], "revision_id long, content_text string, char_count long, word_count long, kind string")
    got = {r["revision_id"]: r for r in quality.statistics(d).collect()}
    assert len(got) == 4 and got[1]["kind"] == "prose" and got[2]["words"] == 0 and got[2]["mean_word_length"] is None
    assert rows(quality.not_prose(d)) == [(3, "junk")]
    assert rows(quality.not_prose(d.limit(0))) == []


# 3


def tiny_models():
    counts = np.zeros((4, ngram.SIZE))
    for i, text in enumerate([PROSE, "What the table protects is not the word itself and every review needs an early fragment", "Der Speicher misst den Fluss und die Grenze, wenn das Ergebnis nicht möglich ist", "La règle dite de la forêt mesure le critère et la qualité du registre"]):
        counts[i] = np.bincount(ngram.trigrams(text), minlength=ngram.SIZE)
    return pairs.Languages(ngram.log_joint(counts)), pairs.Refusals({})


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        ("Konu nedir?", None, "empty"),
        ("Konu nedir?", " ​\n", "empty"),
        ("Konu nedir?", "N/A", "empty"),
        ("Konu nedir?", "no answer", "empty"),
        ("Konu nedir?", "cevap yok", "empty"),
        ("Is it so?", "No", None),
        ("Konu nedir?", "Soru: konu  NEDİR?", "copied"),
        ("Önce bu. Konu nedir?", "Konu nedir? Konu nedir?", "copied"),
        ("Konu nedir?", "Konu nedir? Bu, yeni bir sunucu için anlam kazandı.", None),
        ("Konu nedir?", "Üzgünüm, bu konuda yardımcı olamam.", "refusal"),
        ("Kibar bir ret cümlesi örneği ver.", "Üzgünüm, bu konuda yardımcı olamam.", None),
        ("Konu nedir?", "Uzman değilim ve kesin konuşamam, ama şunu söyleyebilirim: bu yol yeni bir sunucu için açıldı.", None),
        ("Her kaynak gibi bu sunucu nedir, ama kimse bilmiyordu?", "What the table protects is not the word itself and every review needs an early fragment.", "wrong_language"),
        ("Şu cümleyi İngilizceye çevir: Her kaynak gibi bu sunucu.", "What the table protects is not the word itself.", None),
        ("Konu nedir?", "1. Önce bu yol açıldı.\n2. (", "truncated"),
        ("Konu nedir?", "Okuyana zayıf gelen her cümle,", "truncated"),
        ("Konu nedir?", "- bir\n- iki\n- üç", None),
        ("Konu nedir?", "%50", None),
        (None, "Bu yol yeni açıldı.", None),
    ],
)
def test_defects(question, answer, defect):
    got, contexts = pairs.judged(["x", question], ["Bu yol yeni açıldı.", answer], *tiny_models())[1]
    assert (got or ("truncated" if contexts else None)) == defect  # nothing is seen here, so every open end is a cut


#: Phrasings that no exemplar holds.
HELD_OUT = (
    "I'm sorry, but I cannot do that.", "I won't answer this question.", "I refuse to respond.", "Bu soruya yanıt vermek istemiyorum.", "Désolé, je refuse.", "I'm afraid I can't discuss this.", "Dazu möchte ich nichts sagen.",
    "Je ne souhaite pas répondre.", "Buna cevap vermem mümkün değil.", "Bu isteği geri çevirmek zorundayım.", "That goes beyond what I may say.", "Tut mir leid, das ist mir nicht erlaubt.",
)


@pytest.mark.parametrize("answer", HELD_OUT)
def test_declining_answers_that_no_exemplar_holds(answer):
    _, refusals = tiny_models()
    assert refusals.refuses("Was ist das?", answer)
    assert not refusals.refuses("Bir ret cümlesi yaz.", answer)
    assert not refusals.refuses("Was ist das?", f"Şöyle yazılabilir: “{answer}”")
    assert not refusals.refuses("Was ist das?", answer + " Der Speicher misst heute den Fluss und die Grenze im ganzen Land.")


def test_hashed_features_are_the_plain_ones():
    features = sorted(set().union(*(pairs.exemplar_rates(*m) for m in pairs.MODELS)))
    known = {pairs.feature_hash(f): f for f in features}
    assert len(known) == len(features)
    text = "I'm sorry, but I can't help with that. Bu isteğinizi karşılamam mümkün değil; je ne peux pas."
    got = Counter(known[h] for h in pairs.Tokens([text]).features().tolist() if h in known)
    assert got == Counter(f for clause in re.split("[.,;]", text) for f in pairs.clause_features(pairs.normal(clause)) if f in features)


def test_tokens_against_plain_ones():
    token = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[^\w\s]")
    texts = ["Bu yol 3,5 km. İyi mi?", "", "a_b 12.\nx", "…evet (Hayır) 1.2.3"]
    tokens = pairs.Tokens(texts)
    for i, text in enumerate(texts):
        assert (tokens.text_of == i).sum() == len(token.findall(text))
    same = pairs.Tokens(["İYİ iyi", "iyi"])
    assert len(set(same.whole.tolist())) == 1
    alone, among = pairs.Tokens(["ve bir yol açıldı"]), pairs.Tokens(["önce bu. Sonra", "ve bir yol açıldı", "son"])
    at = np.flatnonzero(among.text_of == 1)
    assert (alone.contexts(np.arange(4)) == among.contexts(at)).all()


def test_conversation_pairs(spark):
    schema = "sample_id string, item_language string, messages array<struct<message_role string, content_text string, tool_call_id string>>"
    talk = [("system", "s", None), ("assistant", "hello there", None), ("user", "q1", None), ("assistant", None, "call"), ("tool", "t", "call"), ("assistant", "a1", None), ("user", "q2", None), ("assistant", None, None)]
    d = spark.createDataFrame([("c", "tr", talk), ("n", None, None), ("e", None, [])], schema)
    got = [(r["answer_pos"], r["question"], r["answer"]) for r in pairs.conversation_pairs(d).orderBy("answer_pos").collect()]
    assert got == [(1, None, "hello there"), (5, "q1", "a1"), (7, "q2", None)]
    assert ("c", 7, "empty") in rows(pairs.defective(pairs.conversation_pairs(d)))


def test_contexts_do_not_collide():
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(5)) for n in range(100_000)]
    tokens = pairs.Tokens(words)
    keys = tokens.contexts(np.arange(100_000))
    endings = {w[-3:] for w in words}
    assert len(np.unique(keys[:, 1])) == 100_000 and len(np.unique(keys[:, 0])) == len(endings) == len(np.unique(keys[:, 3]))
    assert len(np.unique(keys)) == 100_000 + 4 * len(endings)


def test_unseen_word_takes_no_counts_of_another(spark):
    whole = [(f"w{i}", 0, None, "Bu kestaneler. Yol bitti.", "tr") for i in range(9)]
    d = spark.createDataFrame([*whole, ("cut", 0, None, "Yol üzerinde yeni bir kestanelerden", "tr"), ("cut", 0, None, "Yol üzerinde yeni bir kestanelerden", "tr"), ("same", 0, None, "Yol üzerinde yeni bir kestaneler", "tr"), (None, 0, None, "Yol üzerinde kestanelerden", "tr")], "record_id string, answer_pos long, question string, answer string, lang string")
    assert rows(pairs.defective(d)) == [("cut", 0, "truncated")]
    key = int(pairs.Tokens(["kestaneler"]).contexts(np.array([0]))[0, 1])
    every = pairs.fit_ends(d.select("answer"))
    assert rows(every.where(f"context = {key}").select("n", "ends")) == [(9, 9)]
    wanted = spark.createDataFrame([([key],)], "contexts array<long>")
    few = pairs.fit_ends(d.select("answer"), wanted)
    assert rows(few.where(f"context = {key}")) == rows(every.where(f"context = {key}")) and few.count() <= every.count()
    assert rows(pairs.fit_ends(d.select("answer"), wanted.limit(0))) == []


# 5


@pytest.mark.parametrize(
    ("line", "types"),
    [
        ("Mail: ayse.demir [at] posta [dot] okul.example için", ["email"]),
        ("Mail adresi kullanici@alan biçiminde, @property", []),
        ("Hakem 0594 652 66 49 hattında", ["phone"]),
        ("Ölçüm 590 65 24 adımda bitti", []),
        ("TCKN: 100 000 001 46", ["id_number"]),
        ("TCKN: 10000000147", []),
        ("TR33 0006 1005 1978 6457 8413 26 hesabı", ["iban"]),
        ("Kart 4111-1111-1111-1111 ile", ["payment_card"]),
        ("Barkod 4111-1111-1111-1111-22", []),
        ("Adres: Kestanelik Cad. No: 12/3", ["address"]),
        ("Kargo 40 Yıldıztepe Street için", ["address"]),
        ("Fidanlık Sokağı kalabalık", []),
        ("Bu bölümü MEHMET GÜNDAĞLIGİL yazdı", ["person_name"]),
        ("Uludağlıgil, Zeynep", ["person_name"]),
        ("Sayın H. Günsurkan geldi", ["person_name"]),
        ("Karabellioğlu, Barış\tahmet.kara@ornek.example\t1999", ["person_name", "email"]),
        ("not: kozpınarsoy yusuf aradı", ["person_name"]),
        ("Ayşe Hatun İlkokulu 1929 yılında açıldı", []),
        ("Dün Mehmet Yılmaz aradı", ["person_name"]),
        ("a letter to John Smith arrived", ["person_name"]),
        ("Pierre Dupont est venu avec Anna Schmidt", ["person_name", "person_name"]),
        ("Wojciech Nowak ve Tuğçe Aydın", ["person_name", "person_name"]),
        ("Sayın Bronisław Kowalczyk geldi", ["person_name"]),
        ("Özdemir, Ayşe", ["person_name"]),
        ("Barış Antlaşması imzalandı", []),
        ("Emre Caddesi ve Deniz Parkı", []),
        ("FI21 1234 5600 0007 85 is the account", ["iban"]),
        ("NO93 8601 1117 947", ["iban"]),
        ("FI21 1234 5600 0007 86", []),
        ("Tel. +49 30 1234567 oder (212) 555-0123", ["phone", "phone"]),
        ("Appelez le 01 23 45 67 89", ["phone"]),
        ("d7 3a 01 23 45 67 89 f6", []),
        ("Barkod 9938 0080 8350 3721 okunamadı", []),
        ("", []),
    ],
)
def test_pii_lines(line, types):
    assert [k for _, _, k in pii.Finder().line(line)] == types


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="0123456789", min_size=1, max_size=18))
def test_feistel_round_trip(value):
    p = pii.Pseudonyms(b"key")
    assert p.restore(p.permute(value, "t"), "t") == value and len(p.permute(value, "t")) == len(value)


def test_dates_of_birth_move_within_their_format(spark):
    p = pii.Pseudonyms(b"key")
    made = p.of("birth_date", "07.03.1987")
    assert re.fullmatch(r"\d\d\.\d\d\.\d{4}", made) and made != "07.03.1987" and pii.day_of(made) is not None
    assert pii.day_of(p.of("birth_date", "1987-03-07")) == pii.day_of(made)
    assert len({p.of("birth_date", f"{d}/1/1990") for d in range(1, 32)}) == 31
    d = spark.createDataFrame([(1, "Doğum tarihi: 07.03.1987\nborn on 31.02.1990\ntoplantı 07.03.1987")], "revision_id long, content_text string")
    assert rows(pii.found_lines(d)) == []
    assert rows(pii.findings(d, key=b"key").select("pii_type", "line_no", "pseudonym")) == [("birth_date", 1, made)]
    assert rows(pii.masked(d, key=b"key"))[0][1] == f"Doğum tarihi: [BIRTH_DATE {made}]\nborn on 31.02.1990\ntoplantı 07.03.1987"


def test_no_key_is_built_in(spark):
    d = spark.createDataFrame([(1, "Kart 4111-1111-1111-1111 ile")], "revision_id long, content_text string")
    assert rows(pii.masked(d, key=b"a")) == rows(pii.masked(d, key=b"a"))
    assert rows(pii.masked(d)) != rows(pii.masked(d))
    with pytest.raises(TypeError):
        pii.Pseudonyms()


def test_pseudonyms_keep_formats():
    p = pii.Pseudonyms(b"key")
    card = p.of("payment_card", "4111-1111-1111-1111")
    assert re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d{4}", card) and pii.luhn(pii.digits(card))
    assert p.of("payment_card", "4111 1111 1111 1111").replace(" ", "-") == card
    number = pii.digits(p.of("id_number", "100 000 001 46"))
    assert pii.id_checks(number[:9]) == number[9:] and number[0] != "0"
    assert pii.iban_rest(p.of("iban", "TR330006100519786457841326")) == 1
    assert p.of("email", "A@b.example") == p.of("email", "a@B.example")


def test_masked(spark):
    d = spark.createDataFrame([(1, "Tel: 0594 652 66 49.\nSon", "p"), (1, "Tel: 0594 652 66 49.\nSon", "p"), (2, None, "q"), (None, "x@y.example", "r")], "revision_id long, content_text string, pii_type string")
    got = {r["revision_id"]: r["masked_text"] for r in pii.masked(d).collect()}
    assert re.fullmatch(r"Tel: \[PHONE 059\d \d{3} \d\d \d\d\]\.\nSon", got[1]) and got[2] is None
    assert rows(pii.found_lines(d)) == [(1, "phone", 1)]


def test_masked_without_ids(spark):
    texts = ["Tel: 0594 652 66 49", "yok", "yok", None]
    d = spark.createDataFrame([(None, t) for t in texts] + [(7, "yok"), (7, "yok")], "revision_id long, content_text string").repartition(3)
    got = pii.masked(d).collect()
    assert sorted(str(r["masked_text"])[:10] for r in got if r["revision_id"] is None) == ["None", "Tel: [PHON", "yok", "yok"]
    assert [r["masked_text"] for r in got if r["revision_id"] == 7] == ["yok"]


@pytest.mark.parametrize(
    ("line", "address"),
    [
        ("Soru: elif_er24 (et) kurum nokta example için", "elif_er24 (et) kurum nokta example"),
        ("ayse+yesil (et) posta nokta okul nokta example Das", "ayse+yesil (et) posta nokta okul nokta example"),
        ("dkara [et] kurum-a [nokta] invalid;1", "dkara [et] kurum-a [nokta] invalid"),
        ("dkara{et}kurum-a(nokta)invalid;1", "dkara{et}kurum-a(nokta)invalid"),
        ("Yaz: UMUT.GUN ET POSTA NOKTA TEST, bekle", "UMUT.GUN ET POSTA NOKTA TEST"),
        ("noz (ET) posta.example, bekle", "noz (ET) posta.example"),
        ("noz@posta nokta example, bekle", "noz@posta nokta example"),
        ("Le chapitre (et) suite. Puis la note et le point", None),
        ("Dikkat et her nokta önemli, not et bir nokta daha", None),
    ],
)
def test_turkish_addresses(spark, line, address):
    assert [line[a:b] for a, b, k in pii.Finder().line(line) if k == "email"] == [address] * (address is not None)
    d = spark.createDataFrame([(1, "Son\n" + line)], "revision_id long, content_text string")
    assert rows(pii.found_lines(d)) == [(1, "email", 2)] * (address is not None)
    text = pii.masked(d, key=b"key").collect()[0]["masked_text"]
    assert text == "Son\n" + (line if address is None else line.replace(address, pii.Pseudonyms(b"key").placeholder("email", address)))


# 4, 6, 7


@pytest.mark.skipif(not VOCABULARY, reason="no vocabulary here")
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_encoding_against_library(texts):
    tok = budget.tokenizer(bpe.VOCABULARY)
    ids = bpe.Encoder().batch(texts).to_pylist()
    assert ids == [tok.encode_ordinary(t) for t in texts]
    assert [tok.decode(i) for i in ids] == texts


@pytest.mark.skipif(not VOCABULARY, reason="no vocabulary here")
def test_encoding_rows(spark):
    long = "aab" * 30000
    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "<|endoftext|> a", 0), (4, long, 0), (4, long, 0)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in bpe.encoded(d).collect()}
    tok = budget.tokenizer(bpe.VOCABULARY)
    assert got[1] == [] and got[2] == [] and got[3] == tok.encode_ordinary("<|endoftext|> a") and got[4] == tok.encode_ordinary(long)
    assert bpe.encoded(d.limit(0)).count() == 0


@pytest.mark.skipif(not VOCABULARY, reason="no vocabulary here")
def test_budget(spark):
    d = spark.createDataFrame([(1, "bir iki", "tr", "s1", 7, None, ""), (2, None, "tr", "s1", None, None, ""), (3, "üç", None, None, 2, None, "")], DOCS)
    e = spark.createDataFrame([(1, "s1", "m", 5, "2026-01-01"), (1, "s1", "m", 9, "2026-02-01"), (2, "s1", "m", None, "2026-01-01")], "doc_id long, source_id string, estimate_method string, estimated_token_count long, t string").withColumn("estimated_at", __import__("pyspark.sql.functions", fromlist=["col"]).to_timestamp("t"))
    s = spark.createDataFrame([("s1", 1, "TR-tr", "Tip ", "a"), ("s1", 2, "tr_TR", "TIP-genel", "b")], "source_id string, source_version long, source_language string, source_domain string, added_at string")
    got = {(r["level"], r["source_id"]): r for r in budget.token_budget(d, e, s).collect()}
    tok = budget.tokenizer(bpe.VOCABULARY)
    top = got[(7, None)]
    assert top["documents"] == 3 and top["tokens"] == len(tok.encode_ordinary("bir iki")) + len(tok.encode_ordinary("üç")) and top["estimated_tokens"] == 9
    one = got[(0, "s1")]
    assert (one["source_language"], one["source_domain"], one["estimated_documents"]) == ("tr", "tip", 1)
    assert got[(0, "unknown")]["source_language"] == "unknown"


def test_mixture(spark):
    rng = random.Random(5)
    words = {"tip": "hasta doktor ilaç tedavi", "tarih": "saray ferman sikke kale"}
    docs = [(i, " ".join(rng.choices(words["tip" if i % 2 else "tarih"].split(), k=30)), "tr", f"s{i % 4}", 200, "tip" if i % 2 else "tarih", "") for i in range(1200)] + [(None, "x", None, "s0", 1, None, ""), (5000, None, None, "s0", None, None, ""), (5001, "", None, None, 0, None, "")]
    d = spark.createDataFrame(docs, DOCS)
    m = spark.createDataFrame(
        [("r", "a", "tip", 0.5, None, ["s1", "s3"], 2, 0.4), ("r", "b", "tarih", 0.5, 1.0, ["s0", "none"], 3, 0.4), ("q", "c", None, 1.0, None, ["s2"], 1, 2.0), ("q", "d", "mixed", None, None, None, None, None)],
        "release_id string, mixture_name string, mixture_domain string, target_share double, sample_weight double, source_ids array<string>, max_repeats int, size_ratio double",
    )
    got = {r["mixture_name"]: r for r in mixing.report(d, m).collect()}
    assert abs(got["a"]["reached"] - 1) < 0.02 and abs(got["b"]["reached"] - 1) < 0.02
    assert got["c"]["documents"] == 300 and got["c"]["most_uses"] == 1 and got["c"]["reached"] < 0.2
    assert got["d"]["uses"] == 0 and got["d"]["reached"] is None
    chosen = mixing.selection(d, m).collect()
    assert all(1 <= r["uses"] <= {"a": 2, "b": 3, "c": 1}[r["mixture_name"]] for r in chosen)
    assert len({(r["release_id"], r["mixture_name"], r["doc_id"]) for r in chosen}) == len(chosen)
    domains = {(r["release_id"], r["domain_name"]): r for r in mixing.domain_report(d, m).collect()}
    assert domains["r", "tip"]["target_chars"] == domains["r", "tarih"]["target_chars"] > 0
    assert abs(domains["r", "tip"]["actual_chars"] / domains["r", "tip"]["target_chars"] - 1) < 0.05
    assert mixing.report(d.limit(0), m).count() == 4 and mixing.report(d, m.limit(0)).count() == 0


def small_plan(weights, targets):
    from pyspark.sql import Row

    rows = [Row(release_id="r", mixture_name=f"m{i}", domain=dom, target_share=t, size_ratio=1.0, sample_weight=w, source_ids=["s"], max_repeats=2) for i, (w, t, dom) in enumerate(zip(weights, targets, ("a", "b"), strict=True))]
    return mixing.Plan(rows, 1000)


def test_rates_meet_component_and_domain_targets():
    plan = small_plan((1.0, 1.0), (0.5, 0.5))
    c = np.array([0, 0, 1, 1])
    p = np.array([[1.0, 0, 0], [0, 1.0, 0], [1.0, 0, 0], [0, 1.0, 0]])
    n = np.array([400.0, 400, 400, 400])
    r, steps, gradient = plan.solve(0, c, p, n)
    whole = np.bincount(c, weights=r * n)
    assert steps < mixing.STEPS and gradient < 1e-5 and np.allclose(whole, 500, rtol=1e-6)
    assert np.allclose(((r * n)[:, None] * p).sum(axis=0)[:2], 500, rtol=1e-3) and r.min() >= 0 and r.max() <= 2
    # text of another domain is avoided where there is a choice
    far = np.array([[1.0, 0, 0], [0, 0, 1.0], [0, 1.0, 0], [0, 0, 1.0]])
    r, _, _ = plan.solve(0, c, far, n)
    assert r[1] < r[0] and r[3] < r[2] and np.allclose(np.bincount(c, weights=r * n), 500, rtol=1e-6)


def test_weight_says_whose_target_gives_way():
    c, p, n = np.array([0, 1]), np.array([[1.0, 0, 0], [1.0, 0, 0]]), np.array([2000.0, 2000.0])
    sizes = []
    for weights in ((9.0, 1.0), (1.0, 9.0)):
        plan = small_plan(weights, (0.5, 0.5))
        assert plan.weight.tolist() == list(weights)
        plan.target = np.array([500.0, 500.0])
        keep, mixing.scaled = mixing.scaled, lambda r, n, cap, target: r
        try:
            sizes.append(plan.solve(0, c, p, n)[0] * n)
        finally:
            mixing.scaled = keep
    assert abs(sizes[0][0] - 500) < abs(sizes[0][1] - 500) and abs(sizes[1][1] - 500) < abs(sizes[1][0] - 500)


def test_posteriors_are_soft_and_whole():
    rng = np.random.default_rng(1)
    log_words = np.log(rng.dirichlet(np.ones(mixing.BUCKETS), size=3)).astype(np.float32)
    q = mixing.posteriors(["bir iki üç " * 40, "", "dört beş", "altı " * 3], log_words)
    assert (q.sum(axis=1) == mixing.LEVELS).all() and q.min() >= 0 and mixing.posteriors([], log_words).shape == (0, 3)


# 8


def item(seed, n=40):
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfghkl')}{rng.choice('aeiou')}{rng.choice('mnprst')}{rng.choice('aeiou')}{rng.randint(0, 9)}x".replace("x", rng.choice("klm")) for _ in range(n)]


def test_leak_cases(spark):
    a, b = item(1), item(2)
    noise = lambda k, n=30: " ".join(item(k, n))
    eighteen, two_bad = a[5:23], list(a[5:25])
    two_bad[6], two_bad[13] = "zzz", "qqq"
    upper = "-\n".join(w.upper() for w in b)
    texts = {
        1: noise(10) + " " + " ".join(eighteen) + " " + noise(11),
        2: noise(12) + " " + " ".join(two_bad) + " " + noise(13),
        3: upper,
        4: " ".join(a[20:] + a[:20]),
        5: noise(14) + " " + " ".join(a[5:13]) + " " + noise(15),
        6: noise(16),
        7: None,
        8: "",
        9: " ".join(item(17, 3000)) + " " + "​ ".join(a[10:35]),
        10: noise(18, 90).join(" " + " ".join(a[k : k + 10]) + " " for k in (30, 0, 20, 10)),
    }
    docs = spark.createDataFrame([(k, t, 9) for k, t in texts.items()] + [(3, upper, 9), (None, upper, 9)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(100, " ".join(a)), (200, " ".join(b)), (300, None), (200, " ".join(b)), (None, "x")], "item_id long, text string")
    assert rows(leak.leaked(docs, items)) == [(1, 100), (2, 100), (3, 200), (4, 100), (9, 100), (10, 100)]
    assert rows(leak.leaked(docs, items.limit(0))) == []


def test_short_items_leak_whole(spark):
    texts = {1: "x Mavi, KAPI y", 2: "kapı mavi", 3: "mavi x kapı", 4: "x BİR ikinci,\nüç dört beş", 5: "kuzu", 6: "bir ikinci üç yedi; bir ikinci üç", 7: "", 8: "a b c d e"}
    items = [(10, "Mavi kapı"), (11, "mavi  kapi!"), (20, "bir ikinci üç dört"), (30, "Kuzu."), (40, "?!"), (50, "a b c d e"), (60, "bir ikinci üç")]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert rows(leak.leaked(docs, spark.createDataFrame(items, "item_id long, text string"))) == [(1, 10), (1, 11), (4, 20), (4, 60), (5, 30), (6, 60), (8, 50)]


def brute_tiling(x, y, least):
    """Longest match first, again and again."""
    free_x, free_y, tiles = [True] * len(x), [True] * len(y), []
    while True:
        best = 0
        for i in range(len(x)):
            for j in range(len(y)):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and free_x[i + n] and free_y[j + n]:
                    n += 1
                best = max(best, n)
        if best < least:
            return tiles
        i, j = next((i, j) for i in range(len(x)) for j in range(len(y)) if all(i + k < len(x) and j + k < len(y) and x[i + k] == y[j + k] and free_x[i + k] and free_y[j + k] for k in range(best)))
        tiles.append((i, j, best))
        for k in range(best):
            free_x[i + k] = free_y[j + k] = False


def test_tiling_never_overlaps():
    rng = random.Random(4)
    for round_ in range(60):
        x, y = np.array([rng.randint(0, 3 + round_) for _ in range(30)], np.uint64), np.array([rng.randint(0, 3 + round_) for _ in range(40)], np.uint64)
        tiles = leak.tiling(leak.Searched(x), y)
        assert all((x[i : i + n] == y[j : j + n]).all() and n >= 2 for i, j, n in tiles)
        for side in (0, 1):
            used = Counter(t[side] + k for t in tiles for k in range(t[2]))
            assert max(used.values(), default=1) == 1
        if round_ > 25:  # ties are rare
            assert sorted(n for _, _, n in tiles) == sorted(n for _, _, n in brute_tiling(x.tolist(), y.tolist(), 2))


def plain_words(text):
    folded = unicodedata.normalize("NFKD", text.replace("ı", "i").replace("İ", "i")).casefold()
    folded = re.sub("[\u0300-\u036f\xad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\u180e\u034f]+", "", folded)
    folded = re.sub(r"(?<=[^\W_])['’`‘‐-](?=[^\W_])", "", folded)
    return re.findall(r"[^\W_]+", re.sub(r"(?<![^\W_])([ldcjmnst]|qu)\s+(?=[^\W_])", r"\1", folded))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abdlquıİISßéê ̈­​'-\n._1½ﬁ", max_size=30), max_size=4))
def test_words_against_plain_ones(texts):
    h, bounds = leak.worded(texts)
    known = {}
    for i, text in enumerate(texts):
        words = plain_words(text)
        own = h[bounds[i] : bounds[i + 1]].tolist()
        assert len(own) == len(words)
        for w, x in zip(words, own, strict=True):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def test_items_in_several_blocks_and_passes(spark, monkeypatch):
    monkeypatch.setattr(leak, "PASS_BLOCKS", 2)
    assert [len(b) for b in leak.blocks(((i, "x" * 10) for i in range(7)), 25)] == [2, 2, 2, 1]
    whole = leak.blocks
    monkeypatch.setattr(leak, "blocks", lambda rows: whole(rows, 300))
    items = [(k, " ".join(item(k))) for k in range(5)]
    docs = spark.createDataFrame([(k, "x " + t) for k, t in items] + [(9, "none")], "doc_id long, text string")
    assert rows(leak.leaked(docs, spark.createDataFrame(items, "item_id long, text string"))) == [(k, k) for k in range(5)]


def test_passage_against_plain_alignment():
    rng = random.Random(6)
    for _ in range(60):
        x, y = [rng.randint(0, 4) for _ in range(12)], [rng.randint(0, 4) for _ in range(15)]
        best, table = 0.0, [[0.0] * 16 for _ in range(13)]
        for i in range(12):
            for j in range(15):
                table[i + 1][j + 1] = max(0, table[i][j] + (1 if x[i] == y[j] else -leak.MISS), table[i][j + 1] - leak.MISS, table[i + 1][j] - leak.MISS)
                best = max(best, table[i + 1][j + 1])
        assert leak.passage(np.array(x), np.array(y))[0] == best


# 9


def repairer():
    counts = np.bincount(ngram.trigrams((PROSE + " çalışmasıyla şehirdeki ağaçların ısınması yılında arşivindeki değerlendirmiştir ") * 5), minlength=ngram.SIZE)
    return mojibake.Repairer(ngram.log_next(counts))


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp1254", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
def test_wrong_decodings_come_back(codec):
    table = {b: ch for ch, b in mojibake._bytes_of(codec).items()}
    text = "Önce çözümü güçlendiren arşiv, ağır yükü taşıyor"
    garbled = "".join(chr(b) if b < 0x80 else table[b] for b in text.encode())
    assert repairer().text(garbled) == (text, True)


@pytest.mark.parametrize("times", [1, 2, 3, 4])
def test_wrong_again_and_again(times):
    rng = random.Random(times)
    for word in ("güneşli", "çağrışım", "Übergröße", "élève", "ılık", "“naïve”") * 8:
        garbled = word
        for _ in range(times):
            raw = garbled.encode("utf-8")
            try:
                garbled = raw.decode(rng.choice(("cp1252", "latin-1", "cp1254", "cp1250")))
            except UnicodeDecodeError:
                garbled = raw.decode("latin-1")
        assert mojibake.search(garbled)[0] == word


def test_twice_wrong_and_legacy():
    text = "Ölçüt güçlü görünüyor"
    twice = text.encode().decode("cp1252").encode().decode("cp1252")
    assert repairer().text(twice) == (text, True)
    assert repairer().text("Yazar arþivindeki deðerlendirmiþtir") == ("Yazar arşivindeki değerlendirmiştir", True)


@pytest.mark.parametrize("garbled", ["g&Atilde;&frac14;n bitti", "g&#195;&#188;n bitti", "g&#xC3;&#xBC;n bitti"])
def test_escaped_garble(spark, garbled):
    assert repairer().text(garbled) == ("gün bitti", True)
    d = spark.createDataFrame([(1, garbled, "tr"), (2, "a &amp; b", "tr"), (3, "AT&T", "tr")], "doc_id long, text string, lang string")
    assert rows(mojibake.affected(d)) == [(1,)]


@pytest.mark.parametrize("codec", ["cp1250", "cp1251", "cp857"])
def test_other_code_pages(codec):
    text = "Yazar arşivindeki değerlendirmiştir"
    table = {b: ch for ch, b in mojibake._bytes_of(codec).items()}
    assert repairer().text("".join(table[b] for b in text.encode("cp1254"))) == (text, True)


@pytest.mark.parametrize("text", ["g&uuml;n &amp; gece", "a&b; R&D", "The mark “&Auml;&Yuml;” is quoted here.", "Constanţa, Đakovo", "Ãnbellekten, Ãerezleri", "x &lt; y &amp;&amp; z"])
def test_escaped_and_foreign_text_stays(text):
    assert repairer().text(text) == (text, False)


@pytest.mark.parametrize(
    "text",
    ["", "Garðabær, Þórshöfn ve Łódź", "Die Folge Ä± nennt man Zeichensalat; hier nur als Beispiel.", "The mark “ÄŸ” is quoted here.", "ÄRZTE und ÅNGSTRÖM", "Привет, мир", "∑ᵢ xᵢ² ≤ 10⁻³", "été über", "漢字かな 👩‍🔬", "Die Folge � nennt man so"],
)
def test_foreign_text_stays(text):
    assert repairer().text(text) == (text, False)


def test_affected_rows(spark):
    bad = "çözüm önemli".encode().decode("cp1252")
    d = spark.createDataFrame([(1, bad, "tr"), (1, bad, "tr"), (2, "çözüm", "tr"), (3, None, None), (4, "", "und"), (5, "g�ncel", None), (6, "iyi\n" * 20000 + bad, None)], "doc_id long, text string, lang string").selectExpr("*", "1 as repaired", "true as restored")
    assert rows(mojibake.affected(d)) == [(1,), (5,), (6,)]
    fixed = {r["doc_id"]: (r["repaired"], r["restored"]) for r in mojibake.repairs(d).collect()}
    assert fixed[1] == ("çözüm önemli", True) and fixed[5][1] is False
    assert rows(mojibake.affected(d.limit(0))) == []
