"""Rule-based document quality and the candidate selection pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators.dedup import _SIG, greedy_resolution, near_pairs
from sievewright.operators.review import revisions
from sievewright.tables import once, positions, spread, table, written

#: Terms of each cluster, matched at word starts.
LEXICONS = {
    "navigation": r"ana\s+sayfa|haber|giriş|kayıt|yorum|paylaş|önceki|sonraki|kategor|menü|iletişim|hakkımızda|arama|facebook|twitter|instagram|takipçi|beğeni",
    "promotion": r"hemen|ücretsiz|tıkla|kampanya|satın\s+al|iletişime\s+geç|en\s+iyi|kaliteli|hizmet|site|online|fiyat|sipariş",
    "dating": r"arkadaş|sohbet|chat|tanış|evlen|partner|flört",
    "optics": r"dürbün|kamera|gece\s+görüş|güvenlik\s+kam|casus|zoom|optik",
    "adult_service": r"escort|eskort|randevu|masaj|ilan|bayan",
    "pharma": r"viagra|cialis|levitra|kamagra|sertleş|iktidarsız|cinsel|eczane|ilaç",
}
#: Least words, distinct terms and hits per thousand words of a cluster.
LIMITS = {"navigation": (1500, 5, 4), "promotion": (1500, 6, 10), "dating": (1000, 3, 8), "optics": (1000, 3, 8), "adult_service": (1000, 3, 8), "pharma": (1000, 3, 8)}
#: Patterns that Java's engine and RE2 read alike: without look-around, boundaries are consumed.
START = r"(?:^|[^\p{L}\p{N}_])"
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?"
URL = r"(?:https?://|www\.)[^\s]+|\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|net|org|info|biz|xyz|site|online|tr|co|io)\b[^\s]*"
CALL = r"(?:^|[^0-9])(?:\+?90\s*)?(?:\(*0?5[0-9]{2}\)*[\s.-]*)?[0-9]{3}[\s.-]*[0-9]{2}[\s.-]*[0-9]{2}(?:[^0-9]|$)"
WIKI = r"align=\"|\{\{|\}\}|\[\[|\]\]"
CYRILLIC, LATIN = r"\x{0400}-\x{052F}", r"A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}"
MIXED = rf"[\p{{L}}\p{{N}}]*(?:[{LATIN}][\p{{L}}\p{{N}}]*[{CYRILLIC}]|[{CYRILLIC}][\p{{L}}\p{{N}}]*[{LATIN}])[\p{{L}}\p{{N}}]*"
EMAIL = r"(?:^|[^\p{L}\p{N}_.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}(?:[^\p{L}\p{N}_.-]|$)"
OTHER = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x{7b}-\x{10FFFF}]"  # all but ASCII letters and digits, as ranges, which Java's engine tests much faster than a negated class
IBAN = rf"(?:^|{OTHER})([Tt][Rr](?: ?[0-9]){{24}})(?:{OTHER}|$)"
MOBILE = r"(?:^|[^0-9])((?:\+?90[\s().-]*)?0?5[0-9]{2}(?:[\s().-]*[0-9]){7})(?:[^0-9]|$)"
CARD = rf"(?:^|{OTHER})([0-9](?:[ -]?[0-9])*)"
PERSONAL = ("national_id", "iban", "email", "phone", "payment_card")
MAX_BYTES = 262144


def folded(c: Column) -> Column:
    return F.lower(F.translate(c, "Iİ", "ıi"))


def hits(c: Column, lexicon: str) -> Column:
    return F.regexp_count(c, F.lit(f"{START}(?:{LEXICONS[lexicon]})"))


def distinct(c: Column, lexicon: str) -> Column:
    return sum((c.rlike(START + term).cast("int") for term in LEXICONS[lexicon].split("|")), F.lit(0))


def rate_at_least(part: Column, whole: Column, permille: int) -> Column:
    return part * 1000 >= whole * permille


def cluster(c: Column, words: Column, lexicon: str) -> Column:
    """Dense enough in enough distinct terms; the cheap word count is tested first."""
    least, terms, permille = LIMITS[lexicon]
    return F.when(words < least, False).when(~rate_at_least(hits(c, lexicon), words, permille), False).otherwise(distinct(c, lexicon) >= terms)


def segments(c: Column) -> Column:
    """Words of each segment of at least 20 characters, cut at lines and sentence ends."""
    parts = F.split(F.regexp_replace(c, r"([.!?…])[ \t\n\r\f\x0b]+", "$1\n"), r"[\n\r]+")
    return F.filter(F.transform(parts, lambda s: F.array_join(F.regexp_extract_all(s, F.lit(WORD), 0), " ")), lambda s: F.char_length(s) >= 20)


def repeats(s: Column) -> Column:
    """How many elements of a sorted array occur more than once, each copy counted."""
    at = lambda i: F.get(s, i)
    same = lambda i, j: F.coalesce(at(i) == at(j), F.lit(False))
    places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: same(i, i - 1) | same(i, i + 1)))


def measured(docs: DataFrame) -> DataFrame:
    """Documents with folded text, words and, of long ones, sorted segments, each computed once."""
    f = folded(F.col("text"))
    d = once(spread(docs.select("doc_id", "text")), "m", F.struct(f.alias("f"), F.regexp_extract_all(f, F.lit(WORD), 0).alias("w")))
    d = d.select("doc_id", "text", F.col("m.f").alias("f"), F.col("m.w").alias("w"), F.size("m.w").alias("words"))
    return once(d, "s", F.when(F.col("words") >= 500, F.sort_array(segments(F.col("f")))).otherwise(F.array().cast("array<string>")))


def reason_columns() -> dict[str, Column]:
    f, words = F.col("f"), F.col("words")
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    repeated = repeats(F.col("s"))
    hashtags, urls = count(f, START + r"#[\p{L}\p{N}]+"), count(f, URL)
    calls = count(F.regexp_replace(f, r"([\s,;|/])", "$1$1"), CALL)  # doubled, so that neighbours share no boundary
    some = lambda name, n: F.when(words < 1000, False).otherwise(distinct(f, name) >= n)
    grams = T.ngrams(F.col("w"), 5)
    unique = lambda share: F.size(F.array_distinct(grams)) * 100 <= F.size(grams) * share
    navigation, promotion = cluster(f, words, "navigation"), cluster(f, words, "promotion")
    #: Only texts that repeat themselves by their words are compressed; the others reach the function as nulls.
    suspect = F.when(words < 500, None).when(unique(60), F.col("text"))
    return {
        "hashtag_stuffing": F.when(hashtags < 50, False).otherwise(rate_at_least(hashtags, words, 50) & (words > 0)),
        "mixed_script_artifact": F.when(count(F.col("text"), r"\x{00AD}") < 20, False).otherwise((count(F.col("text"), f"[{CYRILLIC}]") >= 20) & (count(f, MIXED) >= 20)),
        "extreme_repetition": F.coalesce(T.deflate_permille(suspect) <= 180, F.lit(False)),
        "repeated_segments": F.when(words < 1500, False).when((repeated == 0) | (repeated * 100 < F.size("s") * 20), False).otherwise(unique(70)),
        "navigation_boilerplate": F.when(~navigation, False).otherwise((distinct(f, "promotion") >= 5) | ((F.size("s") > 0) & (repeated * 100 >= F.size("s") * 5)) | (urls + hashtags >= 10)),
        "commercial_keyword_stuffing": F.when(~promotion, False).otherwise((distinct(f, "navigation") >= 3) | (calls + urls >= 2)),
        "dating_cluster": cluster(f, words, "dating") & (some("promotion", 3) | some("navigation", 3)),
        "optics_cluster": cluster(f, words, "optics") & some("promotion", 3),
        "adult_service_cluster": cluster(f, words, "adult_service") & (some("promotion", 3) | some("navigation", 3)),
        "pharma_cluster": cluster(f, words, "pharma") & some("promotion", 3),
        "encoding_corruption": F.col("text").contains("�"),
        "wiki_markup_residue": F.col("text").rlike(WIKI) | (count(F.col("text"), r"\|\|") >= 2),
    }


POLICIES = {
    "none": (),
    "v1": ("hashtag_stuffing", "mixed_script_artifact", "extreme_repetition", "repeated_segments", "navigation_boilerplate", "commercial_keyword_stuffing", "dating_cluster", "optics_cluster", "adult_service_cluster", "pharma_cluster"),
}
POLICIES["v2"] = (*POLICIES["v1"], "encoding_corruption", "wiki_markup_residue")


def reasons(policy: str = "v2") -> Column:
    """Reasons of a policy in fixed order; each rule can be switched by the policy's list."""
    columns = reason_columns()
    return F.filter(F.array(*(F.when(columns[name], F.lit(name)) for name in POLICIES[policy]), F.lit(None).cast("string")), lambda x: x.isNotNull())


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = measured(table(spark, sf_dir, "documents").where("text is not null"))
    return d.select("doc_id", F.col("words").cast("long").alias("words"), F.array_join(reasons(), "|").alias("reasons"))


def lexicon_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and documents of each cluster of terms."""
    d = once(spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")), "f", folded(F.col("text")))
    tall = d.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("lexicon"), hits(F.col("f"), k).alias("n")) for k in LEXICONS))).alias("h"))
    return tall.groupBy("h.lexicon").agg(F.sum("h.n").alias("hits"), F.count_if(F.col("h.n") > 0).alias("documents"))


def structure_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence ends, links and repeated segments of each document."""
    d = measured(table(spark, sf_dir, "documents").where("text is not null"))
    ends = F.regexp_count("text", F.lit(r"[.!?…]"))
    links = F.regexp_count("text", F.lit(URL))
    return d.select("doc_id", ends.cast("long").alias("sentence_ends"), links.cast("long").alias("links"), F.size("s").cast("long").alias("segments"), repeats(F.col("s")).cast("long").alias("repeated"))


def personal_counts(text: Column) -> dict[str, Column]:
    """Findings of each kind of personal number in a text, checked by their digits."""
    groups = lambda pattern: F.regexp_extract_all(F.regexp_replace(text, r"([\s,;|/])", "$1$1"), F.lit(pattern), 1)
    bare = lambda x: F.regexp_replace(x, "[^0-9]", "")
    runs = F.regexp_extract_all(text, F.lit("[0-9]+"), 0)
    return {
        "national_id": F.size(F.filter(runs, lambda r: T.national_id_valid(r))),
        "iban": F.size(F.filter(F.regexp_extract_all(text, F.lit(IBAN), 1), lambda x: T.iban_valid(F.upper(F.replace(x, F.lit(" "), F.lit("")))))),
        "email": F.regexp_count(text, F.lit(EMAIL)),
        "phone": F.size(F.filter(groups(MOBILE), lambda x: T.mobile_valid(bare(x)))),
        "payment_card": F.size(F.filter(F.regexp_extract_all(text, F.lit(CARD), 1), lambda x: T.luhn_valid(bare(x)))),
    }


def drop_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sha, drop_reason) of texts that an earlier run found too large for a batch, once each."""
    big = table(spark, sf_dir, "token_estimates").where("estimated_token_count > 600").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").where("text is not null").join(big, "doc_id", "left_semi").select(F.sha2("text", 256).alias("sha"), F.lit("oversized_estimate").alias("drop_reason")).distinct()


def post_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are taken out after deduplication, by a later decision on their newest estimate."""
    return table(spark, sf_dir, "token_estimates").where("estimated_token_count < 20").select("doc_id").distinct()


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First stage at which each document falls out, or kept.

    Stages in order: oversized, blank, personal_data, drop_list, quality,
    duplicate (of an earlier document that got so far), near_duplicate (of an
    earlier one that stays, by signatures), post_drop (only of train; still in
    the state that later documents are compared with), kept. The costly pass
    over the texts runs once; what follows reads narrow columns.
    """
    d = measured(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    counts = personal_counts(text)
    personal = F.filter(F.array(*(F.when(counts[k] > 0, F.lit(k)) for k in PERSONAL)), lambda x: x.isNotNull())
    early = F.when(F.octet_length(text) + 1 > MAX_BYTES, "oversized").when(F.trim(F.regexp_replace(text, T.SPACES, " ")) == "", "blank")
    normal = T.profile_text(F.col("text"))
    narrow = d.select(
        "doc_id", early.alias("early"), personal.alias("personal"), reasons().alias("reasons"), F.sha2("text", 256).alias("sha"),
        T.fingerprint(normal).alias("fp"), T.simhash(digest="md5")(normal).alias("signature"), F.char_length("text").alias("chars"),
    )
    s = written(narrow, "stages")
    s = s.join(drop_list(spark, sf_dir), "sha", "left")  # no broadcast hint: the list may grow with the corpus
    stage = F.coalesce("early", F.when(F.size("personal") > 0, "personal_data"), F.when(F.col("drop_reason").isNotNull(), "drop_list"), F.when(F.size("reasons") > 0, "quality"))
    s = s.withColumn("stage", stage)
    first = s.where("stage is null and fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    s = s.join(first, "fp", "left").withColumn("stage", F.coalesce("stage", F.when(F.col("first_id") < F.col("doc_id"), "duplicate")))
    s = written(s.select("doc_id", "stage", "sha", "signature", "chars", "reasons", "personal", "first_id"), "deduplicated")
    open_ = s.where("stage is null and signature is not null").select("doc_id", "signature")
    classes = open_.groupBy("signature").agg(F.min("doc_id").alias("class_id"))
    pairs = written(near_pairs(open_), "near")
    nodes = pairs.select(F.col("left_id").alias("class_id")).union(pairs.select("right_id")).distinct()  # classes without a near one stay as they are
    gone = greedy_resolution(pairs, nodes).where("not kept").select("class_id")
    kept = classes.join(gone, "class_id", "left_anti").select(F.col("class_id").alias("doc_id"), F.lit(True).alias("stays"))
    s = s.join(kept, "doc_id", "left").withColumn("stage", F.coalesce("stage", F.when(F.col("signature").isNotNull() & F.col("stays").isNull(), "near_duplicate")))
    held = F.conv(F.substring("sha", 1, 8), 16, 10).cast("long") % 25 == 0
    s = s.join(post_drops(spark, sf_dir).withColumn("later", F.lit(True)), "doc_id", "left").withColumn("stage", F.coalesce("stage", F.when(F.col("later") & ~held, "post_drop"), F.lit("kept")))
    return s.select("doc_id", "stage", F.when(F.col("stage") == "kept", F.when(held, "held_out").otherwise("train")).alias("partition"), "chars", "reasons", "personal", F.when(F.col("stage") == "duplicate", F.col("first_id")).alias("duplicate_of"))


def candidate_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir).select("doc_id", "stage", "partition", "duplicate_of")


def candidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters of each stage and partition."""
    return staged(spark, sf_dir).groupBy("stage", "partition").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


def candidate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that fell out at a stage for each of its reasons."""
    why = F.when(F.col("stage") == "quality", F.col("reasons")).when(F.col("stage") == "personal_data", F.col("personal"))
    d = staged(spark, sf_dir).select("stage", F.explode(why).alias("reason"))
    return d.groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("documents"))


def personal_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and texts with findings of each kind, over all revisions."""
    d = once(spread(revisions(spark, sf_dir).select("content_text")), "c", F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("long").alias("n")) for k, v in personal_counts(F.coalesce("content_text", F.lit(""))).items())))
    return d.select(F.explode("c").alias("x")).groupBy("x.kind").agg(F.sum("x.n").alias("findings"), F.count_if(F.col("x.n") > 0).alias("texts"))


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions as type:verdict."""
    d = staged(spark, sf_dir).select(F.when(F.col("stage") == "kept", F.concat(F.lit("held_out:"), F.when(F.col("partition") == "train", "pass").otherwise("held_out"))).otherwise(F.concat("stage", F.lit(":reject"))).alias("decision"))
    return d.groupBy("decision").agg(F.count(F.lit(1)).alias("decisions"))


def selection_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train selection less later drops, with old and new positions.

    Positions are counted within sources by ranges, so no task sees all rows of a source.
    """
    kept = staged(spark, sf_dir).where("partition = 'train'").join(table(spark, sf_dir, "documents").select("doc_id", "source", "source_ordinal"), "doc_id")
    order = ["source_ordinal", "doc_id"]
    kept = positions(kept.select("doc_id", "source", "source_ordinal"), "source", order, "old_position")
    drops = table(spark, sf_dir, "token_estimates").where("estimated_token_count > 500").select("doc_id").distinct()
    left = kept.join(drops, "doc_id", "left_anti")
    return positions(left, "source", order, "new_position").drop("source_ordinal")


def selection_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected texts joined back by document and compared with the counts that other tables keep of them."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", "source", "n_chars")
    j = docs.join(staged(spark, sf_dir).where("partition = 'train'").select("doc_id"), "doc_id", "left_semi")
    kept = table(spark, sf_dir, "token_estimates").groupBy("doc_id").agg(F.max_by("semantic_codepoints", F.struct("estimated_at", "estimate_method", "semantic_codepoints")).alias("known"))
    j = j.join(kept, "doc_id", "left")
    n = F.char_length("text")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(n != F.col("n_chars")).alias("mismatches"), F.count_if(n != F.col("known")).alias("other_text"), F.sum(F.octet_length("text")).alias("bytes"))


FOLD = "lower(translate({0}, 'Iİ', 'ıi'))"
F_ = FOLD.format("text")
_S = START
P = T.PROFILE_SQL.format("text")
UNITS = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ')"


def _n(pattern: str, c: str = "f") -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def _distinct(name: str) -> str:
    return "(" + " + ".join(f"regexp_matches(f, '{_S}{t}')::INT" for t in LEXICONS[name].split("|")) + ")"


def _cluster(name: str) -> str:
    least, terms, permille = LIMITS[name]
    return f"(n >= {least} AND {_n(f'{_S}(?:{LEXICONS[name]})')} * 1000 >= n * {permille} AND {_distinct(name)} >= {terms})"


_R = "len(list_filter(range(1, len(s) + 1), lambda i: (i > 1 AND s[i] = s[i - 1]) OR (i < len(s) AND s[i] = s[i + 1])))"
_H = _n(_S + r"#[\p{L}\p{N}]+")
_U = _n(URL)
_C = f"len(regexp_extract_all(regexp_replace(f, '([\\s,;|/])', '\\1\\1', 'g'), '{CALL}'))"
_G = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(31))) ELSE [] END"
_TESTS = {
    "hashtag_stuffing": f"{_H} >= 50 AND {_H} * 1000 >= n * 50 AND n > 0",
    "mixed_script_artifact": f"{_n(r'\x{00AD}', 'text')} >= 20 AND {_n(f'[{CYRILLIC}]', 'text')} >= 20 AND {_n(MIXED)} >= 20",
    "extreme_repetition": "false",  # needs a compressor; on these tables no text of 500 words repeats itself so much
    "repeated_segments": f"n >= 1500 AND {_R} > 0 AND {_R} * 100 >= len(s) * 20 AND len(list_distinct({_G})) * 100 <= len({_G}) * 70",
    "navigation_boilerplate": f"{_cluster('navigation')} AND ({_distinct('promotion')} >= 5 OR (len(s) > 0 AND {_R} * 100 >= len(s) * 5) OR {_U} + {_H} >= 10)",
    "commercial_keyword_stuffing": f"{_cluster('promotion')} AND ({_distinct('navigation')} >= 3 OR {_C} + {_U} >= 2)",
    "dating_cluster": f"{_cluster('dating')} AND ({_distinct('promotion')} >= 3 OR {_distinct('navigation')} >= 3)",
    "optics_cluster": f"{_cluster('optics')} AND {_distinct('promotion')} >= 3",
    "adult_service_cluster": f"{_cluster('adult_service')} AND ({_distinct('promotion')} >= 3 OR {_distinct('navigation')} >= 3)",
    "pharma_cluster": f"{_cluster('pharma')} AND {_distinct('promotion')} >= 3",
    "encoding_corruption": "contains(text, chr(65533))",
    "wiki_markup_residue": f"regexp_matches(text, '{WIKI}') OR {_n(r'\|\|', 'text')} >= 2",
}
MEASURED = rf"""m0 AS (SELECT *, {F_} AS f, regexp_extract_all({F_}, '{WORD.replace("'", "''")}') AS w FROM documents),
    m AS (SELECT *, len(w) AS n, CASE WHEN len(w) >= 500 THEN list_sort(list_filter(list_transform(regexp_split_to_array(regexp_replace(f, '([.!?…])[ \t\n\r\f\x0b]+', '\1' || chr(10), 'g'), '[\n\r]+'), lambda x: array_to_string(regexp_extract_all(x, '{WORD.replace("'", "''")}'), ' ')), lambda x: length(x) >= 20)) ELSE [] END AS s FROM m0),
    q AS (SELECT *, concat_ws('|', {", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in _TESTS.items())}) AS reasons FROM m)"""
_ID = "(((substr(x,1,1)::INT + substr(x,3,1)::INT + substr(x,5,1)::INT + substr(x,7,1)::INT + substr(x,9,1)::INT) * 7 - (substr(x,2,1)::INT + substr(x,4,1)::INT + substr(x,6,1)::INT + substr(x,8,1)::INT)) % 10 + 10) % 10 = substr(x,10,1)::INT AND list_sum(list_transform(range(1, 11), lambda i: substr(x, i, 1)::INT)) % 10 = substr(x,11,1)::INT"
_LUHN = "length(x) BETWEEN 13 AND 19 AND length(replace(x, x[1], '')) > 0 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (2 * substr(x, length(x) - i + 1, 1)::INT) // 10 + (2 * substr(x, length(x) - i + 1, 1)::INT) % 10 ELSE substr(x, length(x) - i + 1, 1)::INT END)) % 10 = 0"
_IBAN = "length(x) = 26 AND (substr(x, 5, 22) || '2927' || substr(x, 3, 2))::HUGEINT % 97 = 1"
_MOBILE = "regexp_matches(CASE WHEN length(x) = 12 AND x[1:2] = '90' THEN x[3:] WHEN length(x) = 11 AND x[1] = '0' THEN x[2:] ELSE x END, '^5[0-9]{9}$')"


def personal_sql(c: str) -> dict[str, str]:
    doubled = f"regexp_replace({c}, '([\\s,;|/])', '\\1\\1', 'g')"
    checked = lambda found, keep, test: f"len(list_filter(list_transform({found}, lambda y: regexp_replace(y, '{keep}', '', 'g')), lambda x: {test}))"
    return {
        "national_id": f"len(list_filter(regexp_extract_all({c}, '[0-9]+'), lambda x: CASE WHEN length(x) = 11 AND x[1] <> '0' THEN {_ID} ELSE false END))",
        "iban": checked(f"regexp_extract_all({c}, '{IBAN}', 1)", " ", _IBAN),
        "email": f"len(regexp_extract_all({c}, '{EMAIL}'))",
        "phone": checked(f"regexp_extract_all({doubled}, '{MOBILE}', 1)", "[^0-9]", _MOBILE),
        "payment_card": checked(f"regexp_extract_all({c}, '{CARD}', 1)", "[^0-9]", _LUHN),
    }


_PII = personal_sql("coalesce(text, '')")
STAGED = f"""{_SIG}, {MEASURED},
    dl AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM token_estimates WHERE estimated_token_count > 600)),
    e AS (SELECT q.*, sha256(text) AS sha, s.signature, concat_ws('|', {", ".join(f"CASE WHEN {_PII[k]} > 0 THEN '{k}' END" for k in PERSONAL)}) AS personal FROM (SELECT * EXCLUDE (s) FROM q) q LEFT JOIN s USING (doc_id)),
    g0 AS (SELECT doc_id, text, source, source_ordinal, sha, signature, reasons, personal, CASE WHEN strlen(coalesce(text, '')) + 1 > 262144 THEN 'oversized' WHEN {UNITS} = '' THEN 'blank' WHEN personal <> '' THEN 'personal_data'
      WHEN sha IN (SELECT sha FROM dl) THEN 'drop_list' WHEN reasons <> '' THEN 'quality' END AS stage, CASE WHEN length({P}) >= 32 THEN sha256({P}) END AS fp FROM e),
    h AS (SELECT *, CASE WHEN stage IS NULL AND fp IS NOT NULL THEN min(doc_id) OVER (PARTITION BY fp, stage IS NULL) END AS first_id FROM g0),
    i0 AS (SELECT *, CASE WHEN stage IS NOT NULL THEN stage WHEN first_id < doc_id THEN 'duplicate' END AS stage2 FROM h),
    nc AS (SELECT signature, min(doc_id) AS class_id FROM i0 WHERE stage2 IS NULL AND signature IS NOT NULL GROUP BY signature),
    np AS (SELECT b.class_id AS id, list(a.class_id) AS lefts FROM nc a JOIN nc b ON a.class_id < b.class_id AND bit_count(xor(a.signature, b.signature)) <= 3 GROUP BY b.class_id),
    no AS (SELECT id, lefts, row_number() OVER (ORDER BY id) AS k FROM np),
    nr AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS dropped UNION ALL SELECT nr.k + 1, CASE WHEN len(list_filter(no.lefts, lambda x: NOT list_contains(nr.dropped, x))) > 0 THEN list_append(nr.dropped, no.id) ELSE nr.dropped END FROM nr JOIN no ON no.k = nr.k + 1),
    nd AS (SELECT unnest(dropped) AS id FROM nr WHERE k = (SELECT max(k) FROM nr)),
    i AS (SELECT i0.* EXCLUDE (stage, stage2), CASE WHEN stage2 IS NOT NULL THEN stage2 WHEN signature IS NOT NULL AND (doc_id IN (SELECT id FROM nd) OR doc_id NOT IN (SELECT class_id FROM nc)) THEN 'near_duplicate'
      WHEN doc_id IN (SELECT doc_id FROM token_estimates WHERE estimated_token_count < 20) AND ('0x' || substr(sha, 1, 8))::BIGINT % 25 <> 0 THEN 'post_drop' ELSE 'kept' END AS stage FROM i0),
    st AS (SELECT *, CASE WHEN stage = 'kept' THEN CASE WHEN ('0x' || substr(sha, 1, 8))::BIGINT % 25 = 0 THEN 'held_out' ELSE 'train' END END AS partition FROM i)"""

QUERIES = {
    "quality_rules": (quality_rules, f"WITH {MEASURED} SELECT doc_id, n::BIGINT AS words, reasons FROM q WHERE text IS NOT NULL"),
    "lexicon_statistics": (
        lexicon_statistics,
        f"WITH {MEASURED}, t AS (" + " UNION ALL ".join(f"SELECT '{k}' AS lexicon, {_n(f'{_S}(?:{v})')} AS n FROM m WHERE text IS NOT NULL" for k, v in LEXICONS.items()) + ") SELECT lexicon, sum(n)::BIGINT AS hits, count(*) FILTER (n > 0) AS documents FROM t GROUP BY lexicon",
    ),
    "structure_signals": (structure_signals, f"WITH {MEASURED} SELECT doc_id, {_n('[.!?…]', 'text')}::BIGINT AS sentence_ends, {_n(URL, 'text')}::BIGINT AS links, len(s)::BIGINT AS segments, {_R}::BIGINT AS repeated FROM m WHERE text IS NOT NULL"),
    "candidate_stages": (candidate_stages, f"WITH RECURSIVE {STAGED} SELECT doc_id, stage, partition, CASE WHEN stage = 'duplicate' THEN first_id END AS duplicate_of FROM st"),
    "candidate_reasons": (candidate_reasons, f"WITH RECURSIVE {STAGED}, x AS (SELECT stage, unnest(string_split(CASE WHEN stage = 'quality' THEN reasons ELSE personal END, '|')) AS reason FROM st WHERE stage IN ('quality', 'personal_data')) SELECT stage, reason, count(*) AS documents FROM x GROUP BY ALL"),
    "personal_totals": (
        personal_totals,
        "WITH r AS (SELECT DISTINCT ON (revision_id) content_text FROM document_revisions), t AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {v} AS n FROM r" for k, v in personal_sql("coalesce(content_text, '')").items()) + ") SELECT kind, sum(n)::BIGINT AS findings, count(*) FILTER (n > 0) AS texts FROM t GROUP BY kind",
    ),
    "candidate_report": (candidate_report, f"WITH RECURSIVE {STAGED} SELECT stage, partition, count(*) AS documents, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM st GROUP BY ALL"),
    "decision_counts": (decision_counts, f"WITH RECURSIVE {STAGED} SELECT CASE WHEN stage = 'kept' THEN 'held_out:' || CASE WHEN partition = 'train' THEN 'pass' ELSE 'held_out' END ELSE stage || ':reject' END AS decision, count(*) AS decisions FROM st GROUP BY 1"),
    "selection_subtract": (
        selection_subtract,
        f"""WITH RECURSIVE {STAGED}, k AS (SELECT doc_id, source, source_ordinal, row_number() OVER (PARTITION BY source ORDER BY source_ordinal, doc_id) AS old_position FROM st WHERE partition = 'train')
        SELECT doc_id, source, old_position, row_number() OVER (PARTITION BY source ORDER BY source_ordinal, doc_id) AS new_position FROM k WHERE doc_id NOT IN (SELECT doc_id FROM token_estimates WHERE estimated_token_count > 500 AND doc_id IS NOT NULL)""",
    ),
    "selection_materialize": (
        selection_materialize,
        f"""WITH RECURSIVE {STAGED}, known AS (SELECT doc_id, arg_max(semantic_codepoints, (estimated_at, estimate_method, coalesce(semantic_codepoints, -1))) AS known FROM token_estimates GROUP BY doc_id)
        SELECT st.source, count(*) AS documents, count(*) FILTER (length(st.text) <> d.n_chars) AS mismatches, count(*) FILTER (length(st.text) <> known) AS other_text, sum(strlen(st.text))::BIGINT AS bytes
        FROM st JOIN documents d USING (doc_id) LEFT JOIN known USING (doc_id) WHERE partition = 'train' GROUP BY st.source""",
    ),
}
