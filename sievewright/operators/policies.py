"""The third quality policy, and the choice among all. Third: the second one's triggers, each with a further measure that can spare a document.

Every rule speaks only where the second policy has named its reason, so the
third never rejects what the second keeps, apart from extreme repetition,
whose measure is another one. Signals are those of the document's body, its
text less menus before and comments after its prose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.functions.body import body
from sievewright.operators import candidates as C
from sievewright.operators.pages import _SALES_SQL, _TRANSLATED_SQL, with_commercial, with_translation
from sievewright.tables import once, spread, table

#: Function words, by whose share prose is told from lists.
FUNCTION_WORDS = """
    ve veya ya ile bir bu şu o ne ki de da daha çok az en için gibi kadar göre sonra önce ama fakat ancak çünkü ayrıca hem her tüm bütün bazı hiç artık
    yine ise değil var yok olan olarak olduğu oldu olup oluyor olur ben sen biz siz onlar kendi bile sadece hatta nasıl neden niçin zaten işte birlikte
    arasında içinde üzerine üzere karşı dolayı tarafından böyle öyle şöyle şey mi mı mu mü ilk son diğer birçok birkaç nerede zaman yani ederek eden
    ettiği yapılan yapılması olması bunun onun şeyi kez defa üzerinde altında yanında rağmen ragmen doğru sırasında başka aynı büyük küçük yeni
""".split()  # fmt: skip
#: Calls to act, and prices.
CALLS_TO_ACT = r"hemen\s+ara|hemen\s+arayın|hemen\s+tıkla|whatsapp|watsap|bizi\s+arayın|ücretsiz\s+kargo|sipariş\s+ver|teklif\s+al|fiyat\s+teklifi|iletişime\s+geç|randevu\s+al|hemen\s+üye|kayıt\s+ol|tıklayın"
PRICE = r"[0-9][0-9.,]*\s*(?:tl|lira|usd|euro)\b|[0-9][0-9.,]*\s*[₺$€]"
#: Least or most of each signal.
FUNCTION_SHARE, WIKI_FUNCTION_SHARE, SENTENCE_SHARE = 14, 10, 2  # in a hundred words
CALLS, ACTS, PRICES, LINKS, REPEATS = 5, 3, 12, 5, 20  # links in a thousand words, repeats in a hundred segments
MARGIN = (21, 10)  # density beyond which no signal is asked for, in the second policy's own
WIKI_CHARS, WIKI_SHARE = 2500, 700
TAIL = 64  # characters at the end where one lost character is forgiven
EXTREME_SIZE, EXTREME_GRAMS = 260, 600
MARKUP = r"\{\{[^{}]*\}\}|\{\|[^|]*|\|\}|\[\[(?:[^\[\]|]*\|)?|\]\]|<[^<>]{1,80}>|(?:align|style|class|width)=\"[^\"]*\""


def signals() -> dict[str, Column]:
    """Structural signals of a body, from its folded text, words and sorted segments."""
    f, words = F.col("body_f"), F.size("body_w")
    count = lambda pattern: F.regexp_count(f, F.lit(pattern))
    known = F.size(F.filter("body_w", lambda x: x.isin(*FUNCTION_WORDS)))
    return {
        "no_prose": (words > 0) & (known * 100 < words * FUNCTION_SHARE),
        "no_sentences": (words > 0) & (count("[.!?…]") * 100 < words * SENTENCE_SHARE),
        "contact_cta": (F.regexp_count(F.regexp_replace(f, r"([\s,;|/])", "$1$1"), F.lit(C.CALL)) >= CALLS) | (count(CALLS_TO_ACT) >= ACTS) | (count(PRICE) >= PRICES),
        "link_flood": (words > 0) & (count(C.URL) * 1000 >= words * LINKS),
        "repeated_block": (F.size("all_s") > 0) & (C.repeats(F.col("all_s")) * 100 >= F.size("all_s") * REPEATS),
    }


def measured(docs: DataFrame) -> DataFrame:
    """Documents measured as for the second policy; of those it rejects, their signals too."""
    d = once(C.measured(docs), "v2", C.reasons("v2"))
    hit = F.size("v2") > 0
    d = once(d, "body", body(F.when(hit, F.col("text"))))  # other texts reach the function as nulls
    d = once(d, "body_f", C.folded(F.col("body")))
    d = once(d, "body_w", F.coalesce(F.regexp_extract_all("body_f", F.lit(C.WORD), 0), F.array().cast("array<string>")))
    d = once(d, "all_s", F.when(hit, F.sort_array(C.segments(F.col("body_f")))).otherwise(F.array().cast("array<string>")))
    return once(d, "signals", F.when(hit, F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in signals().items())), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")))


def prose_chars(text: Column) -> Column:
    """Characters of the lines that hold a sentence of eight or more words once markup is blanked."""
    lines = F.split(F.regexp_replace(text, MARKUP, ""), "\n")
    told = F.filter(lines, lambda x: x.rlike("[.!?…]") & (F.regexp_count(x, F.lit(C.WORD)) >= 8))
    return F.aggregate(told, F.lit(0), lambda a, x: a + F.char_length(x))


def lost_character(text: Column) -> Column:
    """Replacement characters beyond a single one at the very end that no word holds."""
    n = F.regexp_count(text, F.lit("�"))
    at, size = F.locate("�", text), F.char_length(text)
    inside = F.substring(text, at - 1, F.lit(1)).rlike(r"[\p{L}\p{N}]") & (at > 1) & F.substring(text, at + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    return (n > 1) | ((n == 1) & ((at - 1 < F.greatest(F.lit(0), size - TAIL)) | inside))


def reasons() -> Column:
    """Reasons of the third policy in fixed order."""
    text, f, words, v2 = F.col("text"), F.col("f"), F.col("words"), F.col("v2")
    named = lambda k: F.array_contains(v2, F.lit(k))
    known, body_words = F.size(F.filter("body_w", lambda x: x.isin(*FUNCTION_WORDS))), F.size("body_w")
    grams = T.ngrams(F.col("w"), 5)
    unique = F.floor(F.size(F.array_distinct(grams)) * 1000 / F.size(grams))
    suspect = F.when(words < 500, None).when(unique <= EXTREME_GRAMS, text)  # other texts reach the function as nulls

    def spared_cluster(reason: str, lexicon: str) -> Column:
        dense = C.hits(f, lexicon) * 1000 * MARGIN[1] >= words * C.LIMITS[lexicon][2] * MARGIN[0]
        return F.when(~named(reason), False).otherwise((F.size("signals") > 0) | dense)

    veto = F.arrays_overlap("signals", F.array(F.lit("contact_cta"), F.lit("link_flood"), F.lit("repeated_block")))
    prose = prose_chars(F.col("body"))
    short = veto | (prose < WIKI_CHARS) | (prose * 1000 < F.char_length("body") * WIKI_SHARE) | (body_words == 0) | (known * 100 < body_words * WIKI_FUNCTION_SHARE)
    tests = {
        "hashtag_stuffing": named("hashtag_stuffing"),
        "mixed_script_artifact": named("mixed_script_artifact"),
        "extreme_repetition": F.coalesce(T.lz77_permille(suspect) <= EXTREME_SIZE, F.lit(False)),
        "repeated_segments": named("repeated_segments"),
        "navigation_boilerplate": named("navigation_boilerplate"),
        "commercial_keyword_stuffing": spared_cluster("commercial_keyword_stuffing", "promotion"),
        "dating_cluster": spared_cluster("dating_cluster", "dating"),
        "optics_cluster": spared_cluster("optics_cluster", "optics"),
        "adult_service_cluster": named("adult_service_cluster"),
        "pharma_cluster": spared_cluster("pharma_cluster", "pharma"),
        "encoding_corruption": F.when(~named("encoding_corruption"), False).otherwise(lost_character(text)),
        "wiki_markup_residue": F.when(~named("wiki_markup_residue"), False).otherwise(short),
    }
    return F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull())


def quality_rules_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of the second and third policies of each document that either rejects."""
    d = measured(table(spark, sf_dir, "documents").where("text is not null"))
    return d.select("doc_id", F.array_join("v2", "|").alias("v2"), F.array_join(reasons(), "|").alias("v3")).where("v2 <> '' or v3 <> ''")


def reasons_under(docs: DataFrame, policy: str) -> DataFrame:
    """(doc_id, reasons) of documents (doc_id, text, url) under a named policy, in the policy's order.

    none has no reasons, v1 and v2 are lists of rules, v3 spares some of v2's
    documents, and v4 is v3 with two more rules.
    """
    if policy in C.POLICIES:
        return C.measured(docs).select("doc_id", C.reasons(policy).alias("reasons") if C.POLICIES[policy] else F.array().cast("array<string>").alias("reasons"))
    if policy not in ("v3", "v4"):
        raise ValueError(f"no policy of this name: {policy}")
    third = measured(docs).select("doc_id", "text", reasons().alias("reasons"))
    if policy == "v3":
        return third.select("doc_id", "reasons")
    pages = with_commercial(with_translation(spread(docs.select("doc_id", "text", "url"))))
    new = F.filter(F.array(F.when(F.col("machine_translation"), F.lit("machine_translation")), F.when(F.col("commercial_page"), F.lit("commercial_page"))), lambda x: x.isNotNull())
    return third.select("doc_id", "reasons").join(pages.select("doc_id", new.alias("new")), "doc_id").select("doc_id", F.concat("reasons", "new").alias("reasons"))


def quality_rules_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the fourth policy rejects and its reasons."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", "url")
    return reasons_under(d, "v4").where(F.size("reasons") > 0).select("doc_id", F.array_join("reasons", "|").alias("reasons"))


def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters before, in and after the body of each document, by source."""
    d = once(spread(table(spark, sf_dir, "documents").where("text is not null").select("source", "text")), "body", body(F.col("text")))
    n = F.char_length("text")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(n).alias("chars"), F.sum(F.char_length("body")).alias("body_chars"), F.count_if(F.char_length("body") < n).alias("trimmed"))


_KNOWN = "len(list_filter(w, lambda x: list_contains([" + ", ".join(f"'{x}'" for x in FUNCTION_WORDS) + "], x)))"
_REP = C._R.replace("s[", "all_s[").replace("len(s)", "len(all_s)")
_SIGNALS = {
    "no_prose": f"n > 0 AND {_KNOWN} * 100 < n * {FUNCTION_SHARE}",
    "no_sentences": f"n > 0 AND {C._n('[.!?…]')} * 100 < n * {SENTENCE_SHARE}",
    "contact_cta": f"{C._C} >= {CALLS} OR {C._n(CALLS_TO_ACT)} >= {ACTS} OR {C._n(PRICE)} >= {PRICES}",
    "link_flood": f"n > 0 AND {C._U} * 1000 >= n * {LINKS}",
    "repeated_block": f"len(all_s) > 0 AND {_REP} * 100 >= len(all_s) * {REPEATS}",
}
_PROSE = f"coalesce(list_sum(list_transform(list_filter(string_split(regexp_replace(text, '{MARKUP}', '', 'g'), chr(10)), lambda x: regexp_matches(x, '[.!?…]') AND len(regexp_extract_all(x, '{C.WORD.replace(chr(39), chr(39) * 2)}')) >= 8), lambda x: length(x))), 0)"
_LOST = "(length(text) - length(replace(text, chr(65533), '')))"
_AT = "strpos(text, chr(65533))"
_INSIDE = f"({_AT} > 1 AND regexp_matches(substr(text, {_AT} - 1, 1), '[\\p{{L}}\\p{{N}}]') AND regexp_matches(substr(text, {_AT} + 1, 1), '[\\p{{L}}\\p{{N}}]'))"


def _has(reason: str) -> str:
    return f"list_contains(v, '{reason}')"


def _spared(reason: str, lexicon: str) -> str:
    hits = C._n(f"{C._S}(?:{C.LEXICONS[lexicon]})")
    return f"({_has(reason)} AND (len(g) > 0 OR {hits} * {1000 * MARGIN[1]} >= n * {C.LIMITS[lexicon][2] * MARGIN[0]}))"


_V3 = {
    "hashtag_stuffing": _has("hashtag_stuffing"),
    "mixed_script_artifact": _has("mixed_script_artifact"),
    "extreme_repetition": "false",  # needs a compressor
    "repeated_segments": _has("repeated_segments"),
    "navigation_boilerplate": _has("navigation_boilerplate"),
    "commercial_keyword_stuffing": _spared("commercial_keyword_stuffing", "promotion"),
    "dating_cluster": _spared("dating_cluster", "dating"),
    "optics_cluster": _spared("optics_cluster", "optics"),
    "adult_service_cluster": _has("adult_service_cluster"),
    "pharma_cluster": _spared("pharma_cluster", "pharma"),
    "encoding_corruption": f"{_has('encoding_corruption')} AND ({_LOST} > 1 OR {_AT} - 1 < greatest(0, length(text) - {TAIL}) OR {_INSIDE})",
    "wiki_markup_residue": f"{_has('wiki_markup_residue')} AND (len(list_intersect(g, ['contact_cta', 'link_flood', 'repeated_block'])) > 0 OR {_PROSE} < {WIKI_CHARS} OR {_PROSE} * 1000 < length(text) * {WIKI_SHARE} OR n = 0 OR {_KNOWN} * 100 < n * {WIKI_FUNCTION_SHARE})",
}
_SEGMENTS = f"list_sort(list_filter(list_transform(regexp_split_to_array(regexp_replace(f, '([.!?…])[ \\t\\n\\r\\f\\x0b]+', '\\1' || chr(10), 'g'), '[\\n\\r]+'), lambda x: array_to_string(regexp_extract_all(x, '{C.WORD.replace(chr(39), chr(39) * 2)}'), ' ')), lambda x: length(x) >= 20))"
V3_SQL = f"""WITH {C.MEASURED}, a AS (SELECT *, {_SEGMENTS} AS all_s, string_split(reasons, '|') AS v FROM q WHERE text IS NOT NULL AND reasons <> ''),
    b AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in _SIGNALS.items())}], lambda x: x IS NOT NULL) AS g FROM a)
    SELECT doc_id, reasons AS v2, concat_ws('|', {", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in _V3.items())}) AS v3 FROM b"""

#: The SQL takes the whole text for the body, which it is wherever a rule depends on it on these tables.
QUERIES = {
    "quality_rules_v3": (quality_rules_v3, V3_SQL),
    "quality_rules_v4": (
        quality_rules_v4,
        f"""SELECT * FROM (SELECT d.doc_id, concat_ws('|', nullif(v.v3, ''), CASE WHEN machine_translation THEN 'machine_translation' END, CASE WHEN commercial_page THEN 'commercial_page' END) AS reasons
        FROM documents d LEFT JOIN ({V3_SQL}) v USING (doc_id) LEFT JOIN ({_TRANSLATED_SQL}) t USING (doc_id) LEFT JOIN ({_SALES_SQL}) s USING (doc_id) WHERE d.text IS NOT NULL) WHERE reasons <> ''""",
    ),
    "page_bodies": (page_bodies, None),
}
