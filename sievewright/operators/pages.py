"""The fourth policy's page-level evidence: markup residue, machine translations and pages that sell, by integer thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.tables import once, spread, table

#: Patterns of markup that never belongs to running text.
MARKUP = {"template": r"\{\{[^{}]*\}\}", "link": r"\[\[[^\[\]]*\]\]", "tag": r"</?[a-z][a-z0-9]*( [^<>]*)?>", "entity": r"&[a-z]{2,8};|&#[0-9]{2,5};"}
#: Families of evidence of a page that sells, on folded text; a letter must not follow the units.
SALES = {
    "price": r"[0-9][0-9.]*,[0-9]{2}\s*(?:(?:tl|ytl|usd|euro|eur)(?:[^\p{L}]|$)|[₺$€])|[0-9][0-9,]*\.[0-9]{2}\s*(?:(?:usd|euro|eur)(?:[^\p{L}]|$)|[$€])|[0-9][0-9.,]*\s*[₺$€]|[₺$€]\s?[0-9]|fiyat(?:ı|lar|ımız)?\s*[:=]\s*[0-9]",
    "cta": r"sepete\s+ekle|satın\s+al(?:ın|mak\s+için)?(?:[^\p{L}]|$)|sipariş\s+ver|hemen\s+sipariş|online\s+sipariş|hemen\s+ara(?:yın)?(?:[^\p{L}]|$)|bizi\s+arayın|teklif\s+al|fiyat\s+teklifi|ücretsiz\s+kargo|kargo\s+bedava"
    r"|aynı\s+gün\s+kargo|ücretsiz\s+teslimat|stok\s+durumu|stokta\s+(?:var|yok)|taksit\s+seçenek|indirimli\s+fiyat|kampanyalı\s+fiyat|whatsapp\s+(?:hattı|destek|sipariş)|hemen\s+indir|ücretsiz\s+indir|şimdi\s+indir|kupon\s+kodu|indirim\s+kodu|promosyon\s+kodu",
    "spec": r"ürün\s+kodu|stok\s+kodu|ürün\s+no(?:[^\p{L}]|$)|marka\s*:|model\s*:|ağırlık\s*:|boyut(?:lar)?\s*:|renk\s*:|malzeme\s*:|garanti\s+süresi|isbn(?:13|10)?(?:[^\p{L}]|$)|barkod|teknik\s+özellikler|ürün\s+özellikleri|kdv\s+dahil|vergiler\s+hariç|kargo\s+ücreti",
    "corp_we": r"(?:^|[^\p{L}])(?:firmamız|şirketimiz|kurumumuz|müşterilerimiz|hizmetlerimiz|ürünlerimiz|markamız|mağazamız|ekibimiz|uzman\s+kadromuz|sunuyoruz|sunmaktayız|hizmet\s+vermekteyiz|hizmetinizdeyiz)",
    "sponsor": r"sponsorlu(?:[^\p{L}]|$)|reklam\s*:|reklamdır|işbirliği\s+ile\s+hazırlan|affiliate|ortaklık\s+bağlantısı|advertorial|tanıtım\s+yazısıdır|bu\s+yazı\s+(?:bir\s+)?(?:reklam|tanıtım)",
    "breadcrumb": r"(?:ana\s*sayfa|anasayfa|home|ev)\s*(?:>|»|›)\s*\p{L}",
}
#: Hits that make a page alone; else two families do. Words of the head whose triples are looked for, and how often one must recur.
STRONG = {"price": 2, "cta": 2, "spec": 2, "sponsor": 1}
HEAD_WORDS, HEAD_REPEATS = 30, 5
#: Words that translations from English favour, and connecting words that they avoid.
CALQUES = "olduğundan sahiptir bunları olun olacaktır aşağıdaki dahil sağlar belirli onları kullanmak gerekiyor hala anda çoğu çeşitli tamamen yoktur gerçekten açıkça yalnızca gerekir onların edilmiş edilmesi takdirde anlamına içerir izin".split()
NATIVE = "kendisine içerisinde ise demek şöyle yanında adlı olma yaptığı ait hep aldığı ederek biçimde üzerine yana yapılan diye yönelik yandan".split()
#: Country endings that are in general use, hosts of community projects, and the thresholds of a profile in thousandths.
GENERAL = "co io tv me cc ws fm ly gg tc az cy".split()
COMMUNITY = r"(?:^|\.)(?:wikipedia|wikimedia|wikivoyage|wiktionary|wikibooks|wikiquote|wikisource|wikinews|wikiversity|wikidata)\.org$"
IN_TURKISH = r"(?:^|/)tr(?:[-_][a-z]{2})?(?:/|$)|[?&](?:lang|hl|language|locale)=tr\b"
LEAST_WORDS, WEAK, STRONG_PROFILE, WITH_THIS = 75, -4, 14, 4
CYRILLIC_LEAST, CYRILLIC_SHARE = 3, 5
THIS = r"(?:^|[.!?…]\s+|\n\s*)Bu,\s"


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def markup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup of each kind and the text's length without it."""
    d = spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"))
    bare = F.col("text")
    for pattern in MARKUP.values():
        bare = F.regexp_replace(bare, pattern, "")
    return d.select("doc_id", *(count(F.col("text"), p).cast("long").alias(k) for k, p in MARKUP.items()), F.char_length(bare).cast("long").alias("bare_chars"))


def head_repeats(words: Column) -> Column:
    """How often the most frequent of the head's triples of words occurs, without overlaps."""
    joined = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    starts = F.when(F.size(words) >= 6, F.sequence(F.lit(1), F.least(F.lit(HEAD_WORDS), F.size(words) - 2))).otherwise(F.array().cast("array<int>"))
    triples = F.filter(F.transform(starts, lambda i: F.slice(words, i, 3)), lambda t: F.exists(t, lambda w: (F.char_length(w) >= 3) & ~w.rlike("^[0-9]+$")))
    found = F.transform(triples, lambda t: F.concat(F.lit(" "), F.array_join(t, "  "), F.lit(" ")))
    return F.coalesce(F.array_max(F.transform(found, lambda x: ((F.char_length(joined) - F.char_length(F.replace(joined, x, F.lit("")))) / F.char_length(x)).cast("long"))), F.lit(0))


def with_commercial(d: DataFrame) -> DataFrame:
    """d with families of sales evidence in its text, and whether they make it a commercial page: two, or enough of one."""
    columns = d.columns
    d = once(d, "_f", F.lower(F.translate("text", "Iİ", "ıi")))
    counts = F.struct(*(F.regexp_count("_f", F.lit(p)).alias(k) for k, p in SALES.items()), head_repeats(F.regexp_extract_all("_f", F.lit(r"[\p{L}\p{N}]+"), 0)).alias("title_repeat"))
    d = once(d, "_c", counts)
    families = F.filter(F.array(*(F.when(F.col(f"_c.{k}") >= (HEAD_REPEATS if k == "title_repeat" else 1), F.lit(k)) for k in (*SALES, "title_repeat"))), lambda x: x.isNotNull())
    strong = F.greatest(*((F.col(f"_c.{k}") >= n).cast("int") for k, n in STRONG.items())) == 1
    return once(d, "families", families).select(*columns, "families", ((F.size("families") >= 2) | strong).alias("commercial_page"))


def with_translation(d: DataFrame) -> DataFrame:
    """d with the signals of a translation in its text and url, and whether they make it a machine translation."""
    columns = d.columns
    d = once(d, "_s", F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in translation_signals(F.col("text"), F.col("url")).items())), lambda x: x.isNotNull()))
    some = lambda *names: F.arrays_overlap("_s", F.array(*map(F.lit, names)))
    made = (some("host_tr", "path_tr", "foreign_cctld") & some("profile_weak", "bu_comma", "cyrillic_residue")) | some("profile_strong", "bu_comma_profile")
    return d.select(*columns, F.col("_s").alias("translation_signals"), made.alias("machine_translation"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", "url"))


def commercial_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of sales evidence in each document."""
    return with_commercial(texts(spark, sf_dir)).select("doc_id", F.array_join("families", "|").alias("families"), "commercial_page")


def translation_signals(text: Column, url: Column) -> dict[str, Column]:
    """Signals of a translated page in its address, words and letters."""
    words = F.regexp_extract_all(F.lower(F.translate(text, "Iİ", "ıi")), F.lit(r"\p{L}+"), 0)
    n = F.size(words)
    profile = (F.size(F.filter(words, lambda w: w.isin(*CALQUES))) - F.size(F.filter(words, lambda w: w.isin(*NATIVE)))) * 1000
    long_enough = n >= LEAST_WORDS
    low = F.lower(F.trim(url))
    host = F.regexp_replace(F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), r"\.$", "")
    known = F.coalesce((host != "") & ~host.rlike(COMMUNITY), F.lit(False))
    rest = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    ending = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    cyrillic, letters = F.regexp_count(text, F.lit(r"[\x{0400}-\x{04FF}]")), F.regexp_count(text, F.lit(r"\p{L}"))
    this = F.regexp_count(text, F.lit(THIS)) >= 1
    return {
        "host_tr": known & host.startswith("tr."), "path_tr": known & rest.rlike(IN_TURKISH), "foreign_cctld": known & (ending != "") & (ending != "tr") & ~ending.isin(*GENERAL),
        "profile_weak": long_enough & (profile >= n * WEAK), "profile_strong": long_enough & (profile >= n * STRONG_PROFILE), "bu_comma": this, "bu_comma_profile": this & long_enough & (profile >= n * WITH_THIS),
        "cyrillic_residue": (cyrillic >= CYRILLIC_LEAST) & (cyrillic * 100 < letters * CYRILLIC_SHARE),
    }


def translated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each document that has one, and whether they make it a machine translation."""
    d = with_translation(texts(spark, sf_dir)).where(F.size("translation_signals") > 0)
    return d.select("doc_id", F.array_join("translation_signals", "|").alias("signals"), "machine_translation")


def repeated_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document's first three words recur in it, without overlaps."""
    d = once(spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")), "w", T.tokens(T.profile_text(F.col("text"))))
    joined = F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" "))
    head = F.concat(F.lit(" "), F.array_join(F.slice("w", 1, 3), "  "), F.lit(" "))
    n = (F.char_length(joined) - F.char_length(F.replace(joined, head, F.lit("")))) / F.char_length(head)
    return d.where(F.size("w") >= 3).select("doc_id", F.round(n).cast("long").alias("times"))


LOWER = "lower(replace(text, 'İ', 'i'))"
_P = T.PROFILE_SQL.format("text")


_HEADS = f"""coalesce(list_max(list_transform(list_filter(list_transform(range(1, CASE WHEN len(w) >= 6 THEN least({HEAD_WORDS}, len(w) - 2) ELSE 0 END + 1), lambda i: w[i:i + 2]), lambda t: len(list_filter(t, lambda y: length(y) >= 3 AND NOT regexp_matches(y, '^[0-9]+$'))) > 0),
    lambda t: (length(joined) - length(replace(joined, ' ' || array_to_string(t, '  ') || ' ', ''))) // length(' ' || array_to_string(t, '  ') || ' '))), 0)"""
_SALES_SQL = rf"""WITH f AS (SELECT doc_id, lower(translate(text, 'Iİ', 'ıi')) AS f FROM documents WHERE text IS NOT NULL), g AS (SELECT *, regexp_extract_all(f, '[\p{{L}}\p{{N}}]+') AS w, ' ' || array_to_string(regexp_extract_all(f, '[\p{{L}}\p{{N}}]+'), '  ') || ' ' AS joined FROM f),
    c AS (SELECT doc_id, {", ".join(f"len(regexp_extract_all(f, '{p}')) AS {k}" for k, p in SALES.items())}, {_HEADS} AS title_repeat FROM g),
    e AS (SELECT *, concat_ws('|', {", ".join(f"CASE WHEN {k} >= {HEAD_REPEATS if k == 'title_repeat' else 1} THEN '{k}' END" for k in (*SALES, "title_repeat"))}) AS families FROM c)
    SELECT doc_id, families, contains(families, '|') OR {" OR ".join(f"{k} >= {n}" for k, n in STRONG.items())} AS commercial_page FROM e"""
_IN = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"
_URL_SIGNALS = {
    "host_tr": "known AND starts_with(host, 'tr.')", "path_tr": f"known AND regexp_matches(rest, '{IN_TURKISH}')", "foreign_cctld": f"known AND ending <> '' AND ending <> 'tr' AND NOT list_contains({_IN(GENERAL)}, ending)",
    "profile_weak": f"n >= {LEAST_WORDS} AND profile >= n * {WEAK}", "profile_strong": f"n >= {LEAST_WORDS} AND profile >= n * {STRONG_PROFILE}", "bu_comma": "this", "bu_comma_profile": f"this AND n >= {LEAST_WORDS} AND profile >= n * {WITH_THIS}",
    "cyrillic_residue": f"cy >= {CYRILLIC_LEAST} AND cy * 100 < letters * {CYRILLIC_SHARE}",
}
_TRANSLATED_SQL = rf"""WITH a AS (SELECT doc_id, text, lower(trim(url)) AS low, regexp_extract_all(lower(translate(text, 'Iİ', 'ıi')), '\p{{L}}+') AS w FROM documents WHERE text IS NOT NULL),
    b AS (SELECT *, len(w) AS n, (len(list_filter(w, lambda x: list_contains({_IN(CALQUES)}, x))) - len(list_filter(w, lambda x: list_contains({_IN(NATIVE)}, x)))) * 1000 AS profile, regexp_replace(regexp_extract(low, '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '\.$', '') AS host,
      regexp_extract(low, '^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest, len(regexp_extract_all(text, '[\x{{0400}}-\x{{04FF}}]')) AS cy, len(regexp_extract_all(text, '\p{{L}}')) AS letters, regexp_matches(text, '{THIS}') AS this FROM a),
    c AS (SELECT *, coalesce(host <> '' AND NOT regexp_matches(host, '{COMMUNITY}'), false) AS known, regexp_extract(host, '\.([a-z]{{2}})$', 1) AS ending FROM b),
    s AS (SELECT doc_id, list_filter([{", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in _URL_SIGNALS.items())}], lambda x: x IS NOT NULL) AS s FROM c)
    SELECT doc_id, array_to_string(s, '|') AS signals, (len(list_intersect(s, ['host_tr', 'path_tr', 'foreign_cctld'])) > 0 AND len(list_intersect(s, ['profile_weak', 'bu_comma', 'cyrillic_residue'])) > 0) OR len(list_intersect(s, ['profile_strong', 'bu_comma_profile'])) > 0 AS machine_translation FROM s WHERE len(s) > 0"""
_BARE = "text"
for _p in MARKUP.values():
    _BARE = f"regexp_replace({_BARE}, '{_p}', '', 'g')"

QUERIES = {
    "markup_counts": (markup_counts, "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS {k}" for k, p in MARKUP.items()) + f", length({_BARE})::BIGINT AS bare_chars FROM documents WHERE text IS NOT NULL"),
    "commercial_pages": (commercial_pages, _SALES_SQL),
    "translated_pages": (translated_pages, _TRANSLATED_SQL),
    "repeated_heads": (
        repeated_heads,
        f"WITH t AS (SELECT doc_id, regexp_extract_all({_P}, '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents WHERE text IS NOT NULL), j AS (SELECT doc_id, ' ' || array_to_string(w, '  ') || ' ' AS x, ' ' || array_to_string(w[1:3], '  ') || ' ' AS h FROM t WHERE len(w) >= 3) SELECT doc_id, ((length(x) - length(replace(x, h, ''))) // length(h))::BIGINT AS times FROM j",
    ),
}
