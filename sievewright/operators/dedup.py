"""Duplicates, near duplicates and decontamination."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators.identity import perturbed, perturbed_sql
from sievewright.tables import spread, table, written

NEAR, APPROXIMATE = 3, 10
#: Signatures are cut into BLOCKS parts; two that differ in at most NEAR bits agree in BLOCKS - NEAR of them.
BLOCKS = 6
ITEM_SIGNATURES = 1 << 20  # signatures of reference items in one block, 8 MB


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_fingerprints").where("normalized_sha256 is not null")


def normalized_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus copies within each source."""
    lines = fingerprints(spark, sf_dir).select("source_id", "fingerprint_version", "normalized_sha256", "source_ordinal").distinct()
    by = lines.groupBy("source_id", "fingerprint_version", "normalized_sha256").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("source_id").agg(F.sum("n").alias("lines"), F.sum(F.col("n") - 1).alias("surplus"), F.count_if(F.col("n") > 1).alias("groups"))


def cross_source_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each source whose text also occurs in sources outside its family.

    Rows are first reduced to one a source and hash; hashes that occur in the
    same set of sources are then one row with sums, so the pairs of a set are
    formed once for all its texts, and never pairs of lines.
    """
    each = fingerprints(spark, sf_dir).groupBy("fingerprint_version", "normalized_sha256", "source_id").agg(F.count_distinct("source_ordinal").alias("lines"))
    sets = each.groupBy("fingerprint_version", "normalized_sha256").agg(F.sort_array(F.collect_list(F.struct("source_id", "lines"))).alias("s")).where(F.size("s") > 1)
    tall = sets.select(F.transform("s", lambda x: x["source_id"]).alias("others"), F.explode("s").alias("x"))
    sums = tall.groupBy("others", F.col("x.source_id").alias("source_id")).agg(F.sum("x.lines").alias("lines"))
    family = families(spark, sf_dir).groupBy("source_id").agg(F.collect_set("relative_id").alias("family"))  # sources, not lines
    known = sums.join(family, "source_id", "left").withColumn("family", F.coalesce("family", F.array().cast("array<string>")))
    foreign = F.array_except("others", F.concat("family", F.array("source_id")))
    hit = known.select("source_id", "lines", foreign.alias("foreign")).where(F.size("foreign") > 0)
    lines = hit.groupBy("source_id").agg(F.sum("lines").alias("lines"))
    sources = hit.select("source_id", F.explode("foreign").alias("other")).groupBy("source_id").agg(F.count_distinct("other").alias("sources"))
    return lines.join(sources, "source_id").select("source_id", "lines", "sources")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivation edges: the first source of a component is the parent of its others."""
    m = table(spark, sf_dir, "release_mixture").where(F.size("source_ids") > 1)
    return m.select(F.col("source_ids")[0].alias("parent_id"), F.explode(F.slice("source_ids", F.lit(2), F.size("source_ids"))).alias("child_id")).where("parent_id <> child_id").distinct()


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source with its ancestors, its descendants and the sources that share an ancestor with it."""
    return relatives(edges(spark, sf_dir))


def closure(e: DataFrame, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """(source_id, ancestor_id) along any chain of edges; cycles end.

    Distinct pairs are joined with themselves until none is new, so a chain of
    n edges takes about log2(n) rounds and a dense graph no more than its pairs.
    """
    up = written(e.select(F.col(child).alias("source_id"), F.col(parent).alias("ancestor_id")).where("source_id is not null and ancestor_id is not null").distinct(), "lineage")
    n, before = up.count(), -1
    while n != before:
        longer = up.alias("a").join(up.alias("b"), F.col("a.ancestor_id") == F.col("b.source_id")).select("a.source_id", "b.ancestor_id")
        up = written(up.unionByName(longer).distinct(), "lineage")
        before, n = n, up.count()
    return up


def relatives(e: DataFrame, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """(source_id, relative_id): ancestors, descendants, and sources with a common ancestor."""
    up = closure(e, parent, child)
    own = up.select("source_id").union(up.select("ancestor_id")).distinct().select("source_id", F.col("source_id").alias("ancestor_id"))
    every = up.unionByName(own)
    pairs = every.alias("a").join(every.alias("b"), F.col("a.ancestor_id") == F.col("b.ancestor_id"))
    return pairs.select("a.source_id", F.col("b.source_id").alias("relative_id")).where("source_id <> relative_id").distinct()


def exact_file_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest source version of each object is canonical."""
    w = Window.partitionBy("source_sha256")
    first = F.min(F.struct("added_at", "source_id", "source_version")).over(w)
    s = table(spark, sf_dir, "release_sources").select("source_id", "source_version", "source_sha256", "added_at").distinct().withColumn("first", first)
    return s.select(
        "source_id", "source_version", F.col("first.source_id").alias("canonical_id"), F.col("first.source_version").alias("canonical_version"),
        ((F.col("first.source_id") != F.col("source_id")) | (F.col("first.source_version") != F.col("source_version"))).alias("duplicate"),
    )


def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the first of its normalized text; first seen wins.

    A hot text is pre-aggregated map-side by the min aggregate, then joined back.
    """
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    d = written(texts.select("doc_id", T.fingerprint(T.profile_text(F.col("text"))).alias("fp")), "fingerprints")  # used twice, two columns
    first = d.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return d.join(first, "fp", "left").select("doc_id", F.coalesce("first_id", "doc_id").alias("first_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def exact_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that equal an evaluation item after normalization."""
    key = lambda c: F.sha2(T.profile_text(F.col(c)), 256)
    items = table(spark, sf_dir, "eval_items").where(F.col("item_split").isin("eval", "holdout")).select(key("text").alias("k")).distinct()
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", key("text").alias("k")).join(items, "k", "left_semi").select("doc_id")


def signatures(docs: DataFrame, id_col: str, digest: str = "md5") -> DataFrame:
    """(id, signature) of each text with five or more words."""
    normal = spread(docs.select(id_col, "text")).select(F.col(id_col), T.profile_text(F.col("text")).alias("normal"))
    return normal.select(F.col(id_col), T.simhash(digest=digest)("normal").alias("signature")).where("signature is not null")


def simhash_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", T.bit_string(F.col("signature")).alias("bits"))


def simhash_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures(table(spark, sf_dir, "documents"), "doc_id", "blake2b").select("doc_id", F.hex("signature").alias("signature"))


def block_keys(signature: Column, blocks: int = BLOCKS, agree: int = BLOCKS - NEAR) -> Column:
    """Keys of all choices of agreeing blocks; complete for at most blocks - agree differing bits.

    Three of six blocks make keys of about 32 bits, so a bucket holds a few
    signatures even of ten billion, unlike single blocks of 16 bits.
    """
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = lambda i: F.shiftrightunsigned(signature, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    return F.array(*(F.xxhash64(F.lit(k), *(part(i) for i in chosen)) for k, chosen in enumerate(combinations(range(blocks), agree))))


def near_pairs(sigs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pairs of class representatives within NEAR bits; equal signatures are one class."""
    classes = sigs.groupBy("signature").agg(F.min(id_col).alias("class_id"))
    keyed = classes.select("class_id", "signature", F.explode(block_keys(F.col("signature"))).alias("key"))
    left, right = keyed.alias("l"), keyed.alias("r")
    pairs = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.class_id") < F.col("r.class_id")) & (T.hamming(F.col("l.signature"), F.col("r.signature")) <= NEAR))
    return pairs.select(F.col("l.class_id").alias("left_id"), F.col("r.class_id").alias("right_id"), T.hamming(F.col("l.signature"), F.col("r.signature")).cast("long").alias("distance")).distinct()


def revision_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all revisions, whose versions are near copies of each other."""
    return table(spark, sf_dir, "document_revisions").select(F.col("revision_id").alias("doc_id"), F.col("content_text").alias("text")).where("doc_id is not null").dropDuplicates(["doc_id"])


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(written(signatures(revision_texts(spark, sf_dir), "doc_id"), "signatures")).withColumn("points", T.similarity_points(F.col("distance")))


def signature_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each revision with the class of equal signatures; near classes are pairs in near_duplicate_pairs."""
    sigs = written(signatures(revision_texts(spark, sf_dir), "doc_id"), "signatures")  # used twice, two columns
    classes = sigs.groupBy("signature").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return sigs.join(classes, "signature").select("doc_id", "class_id", "copies")


def greedy_resolution(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Kept nodes of the lexicographically first maximal independent set.

    In id order a node is dropped if a kept smaller node is near. Each round
    settles all nodes whose smaller neighbours are settled, at least the
    smallest open one, so chains of any length end; the state is written to
    the shared folder, and only counts come to the driver. Pairs that don't
    rise from left to right may never settle and are an error.
    """
    state = written(nodes.select("class_id", F.lit(None).cast("boolean").alias("kept")), "resolution")
    left = state.count()
    near = written(pairs.select("left_id", "right_id"), "near") if left else None
    while left != 0:
        smaller = near.join(state.select(F.col("class_id").alias("left_id"), "kept"), "left_id")
        seen = smaller.groupBy(F.col("right_id").alias("class_id")).agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.bool_or(F.col("kept").isNull()).alias("open"))
        joined = state.join(seen, "class_id", "left")
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(F.coalesce("open", F.lit(False)), None).otherwise(True)
        state = written(joined.select("class_id", now.alias("kept")), "resolution")
        before, left = left, state.where("kept is null").count()
        if left and left == before:
            raise ValueError(f"{left} classes stay open: pairs do not rise from left to right")
    return state


def near_duplicate_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which signature classes stay when later near copies are dropped in order."""
    sigs = written(signatures(revision_texts(spark, sf_dir), "doc_id"), "signatures")
    nodes = sigs.groupBy("signature").agg(F.min("doc_id").alias("class_id"))
    return greedy_resolution(near_pairs(sigs), nodes)


def near_duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs within and across sources, by distance."""
    source = table(spark, sf_dir, "document_revisions").select(F.col("revision_id").alias("doc_id"), "source_id").distinct()
    side = lambda n: source.select(F.col("doc_id").alias(f"{n}_id"), F.col("source_id").alias(f"{n}_source"))
    p = near_duplicate_pairs(spark, sf_dir).join(side("left"), "left_id").join(side("right"), "right_id")
    return p.groupBy("distance", F.when(F.col("left_source").eqNullSafe(F.col("right_source")), "within").otherwise("across").alias("relation")).agg(F.count(F.lit(1)).alias("pairs"))


def closest_pairs(spark: SparkSession, sf_dir: str, size: int = 100) -> DataFrame:
    """The closest pairs of classes, then the smaller ids: a top-k report that keeps size rows a task."""
    return near_duplicate_pairs(spark, sf_dir).select("left_id", "right_id", "distance").orderBy("distance", "left_id", "right_id").limit(size)


def nearest_items(signature_rows: DataFrame, items: DataFrame, key: str, most: int = APPROXIMATE) -> DataFrame:
    """(signature, distance, item) of the nearest item within most bits that shares one of the eight bytes.

    The items are a stated query set: their distinct signatures are compared as
    numbers, block by block, with all signatures, which are never shuffled.
    """
    import numpy as np
    import pyarrow as pa

    spark = signature_rows.sparkSession
    blocks, rows = [], items.groupBy("signature").agg(F.min(key).alias("item")).orderBy("item").toLocalIterator()
    while block := [tuple(r) for _, r in zip(range(ITEM_SIGNATURES), rows, strict=False)]:
        blocks.append(spark.sparkContext.broadcast((np.array([s for s, _ in block], np.int64), np.array([i for _, i in block], np.int64))))

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            best, item = np.full(len(own), 65, np.int64), np.zeros(len(own), np.int64)
            for held in blocks:
                known, ids = held.value
                for a in range(0, len(own), max(1, (1 << 22) // len(known))):
                    part = own[a : a + max(1, (1 << 22) // len(known))]
                    x = (part[:, None] ^ known[None, :]).view(np.uint64)
                    d = np.bitwise_count(x).astype(np.int64)
                    d[~(x.view(np.uint8).reshape(*x.shape, 8) == 0).any(axis=2)] = 65
                    at = d.argmin(axis=1)
                    near = d[np.arange(len(part)), at]
                    nearer = near < best[a : a + len(part)]  # items rise, so the first of equals stays
                    best[a : a + len(part)][nearer], item[a : a + len(part)][nearer] = near[nearer], ids[at[nearer]]
            some = np.flatnonzero(best <= most)
            yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(best[some]), pa.array(item[some])], names=["signature", "distance", "item"])

    return signature_rows.select("signature").mapInArrow(run, "signature long, distance long, item long")


def approximate_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest evaluation item of each document within ten bits that shares a block of eight bits."""
    docs = written(signatures(table(spark, sf_dir, "documents"), "doc_id"), "signatures")
    best = nearest_items(docs.select("signature").distinct(), signatures(table(spark, sf_dir, "eval_items"), "item_id"), "item_id")
    return docs.join(best, "signature").select("doc_id", F.col("item").alias("item_id"), "distance")


def decontamination_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome for each source: blocked by an exact or a near match, passed, or not evaluated without references."""
    references = table(spark, sf_dir, "eval_items").where(F.col("item_split").isin("eval", "holdout") & F.col("text").isNotNull())
    have = references.agg(F.count(F.lit(1)).alias("refs"))
    docs = table(spark, sf_dir, "documents").where("source is not null and text is not null").select("doc_id", "source")
    exact = exact_decontamination(spark, sf_dir).select("doc_id", F.lit(1).alias("exact"))
    near = approximate_decontamination(spark, sf_dir).select("doc_id", F.lit(1).alias("near"))
    g = docs.join(exact, "doc_id", "left").join(near, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("exact"), F.lit(0)).alias("exact"), F.coalesce(F.sum("near"), F.lit(0)).alias("near"))
    outcome = F.when(F.col("refs") == 0, "not_evaluated").when(F.col("exact") + F.col("near") > 0, "blocked").otherwise("passed")
    return g.join(F.broadcast(have), F.lit(True)).select("source", "documents", "exact", "near", outcome.alias("outcome"))  # one row


def corpus_pair_histogram(spark: SparkSession, sf_dir: str, size: int = 2000) -> DataFrame:
    """Distances between all pairs of a bounded sample of documents (a sampling operator), counted in one block."""
    import numpy as np
    import pandas as pd

    s = signatures(table(spark, sf_dir, "documents"), "doc_id").withColumn("k", F.sha2(F.col("doc_id").cast("string"), 256)).orderBy("k").limit(size)

    def count(rows):
        whole = np.concatenate([np.empty(0, np.int64), *(r["signature"].to_numpy(dtype=np.int64) for r in rows)]).view(np.uint64)
        found = np.zeros(65, dtype=np.int64)
        for i in range(len(whole) - 1):
            found += np.bincount(np.bitwise_count(whole[i + 1 :] ^ whole[i]), minlength=65)
        yield pd.DataFrame({"distance": np.arange(65), "pairs": found})

    return s.select("signature").coalesce(1).mapInPandas(count, "distance long, pairs long").where("pairs > 0")


def perturbation_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between documents and four kinds of slightly changed copies: in all, by kind and by length."""
    docs = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null")
    p = written(spread(perturbed(docs, "doc_id")), "perturbed")
    simhash = T.simhash(digest="md5")
    two = p.select("doc_id", "kind", "words", simhash("text").alias("other"))
    one = signatures(docs, "doc_id")
    d = one.join(two, "doc_id").select("kind", F.when(F.col("words") < 50, "short").when(F.col("words") < 150, "middle").otherwise("long").alias("length"), T.hamming(F.col("signature"), F.col("other")).cast("long").alias("distance"))
    g = d.where("distance is not null").groupingSets([[F.col("distance")], [F.col("kind"), F.col("distance")], [F.col("length"), F.col("distance")]], F.col("kind"), F.col("length"), F.col("distance"))
    return g.agg(F.count(F.lit(1)).alias("copies")).select("kind", "length", "distance", "copies")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each threshold the share of changed copies that it finds and the share of sampled pairs that it links."""
    h = corpus_pair_histogram(spark, sf_dir)
    copies = perturbation_distances(spark, sf_dir).where("kind is null and length is null").select("distance", "copies")
    steps = spark.range(65).select(F.col("id").alias("threshold"))
    filled = steps.join(h, F.col("threshold") == h["distance"], "left").join(copies, F.col("threshold") == copies["distance"], "left").select("threshold", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("copies", F.lit(0)).alias("copies"))
    upto, whole = Window.orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()  # 65 rows
    share = lambda c: T.basis_points(F.sum(c).over(upto), F.sum(c).over(whole))
    return filled.select("threshold", F.sum("pairs").over(upto).alias("pairs_within"), share("pairs").alias("pair_points"), F.sum("copies").over(upto).alias("copies_within"), share("copies").alias("recall_points"))


P = T.PROFILE_SQL.format("text")


def _signature_sql(table_name: str, key: str) -> str:
    return f"""t AS (SELECT {key}, regexp_extract_all({P}, '[\\p{{L}}\\p{{N}}_]+') AS w FROM {table_name} WHERE text IS NOT NULL),
    g AS (SELECT {key}, len(w) - 2 AS n, unnest(list_transform(range(1, len(w) - 1), lambda i: ('0x' || substr(md5(array_to_string(w[i:i + 2], chr(31))), 1, 16))::UBIGINT)) AS h FROM t WHERE len(w) >= 5),
    b AS (SELECT {key}, any_value(n) AS n, i, sum((h >> i) & 1) AS ones FROM g, range(64) r(i) GROUP BY {key}, i),
    s AS (SELECT {key}, sum(CASE WHEN 2 * ones > n THEN (1::UBIGINT << i)::HUGEINT ELSE 0 END)::UBIGINT AS signature FROM b GROUP BY {key})"""


_SIG = _signature_sql("documents", "doc_id")
_REVISIONS = "rv AS (SELECT DISTINCT ON (revision_id) revision_id AS doc_id, content_text AS text FROM document_revisions WHERE revision_id IS NOT NULL)"
_RSIG = f"{_REVISIONS}, {_signature_sql('rv', 'doc_id')}"
_NEAR = f"""{_RSIG}, c AS (SELECT signature, min(doc_id) AS class_id FROM s GROUP BY signature),
    np AS (SELECT a.class_id AS left_id, b.class_id AS right_id, bit_count(xor(a.signature, b.signature))::BIGINT AS distance FROM c a JOIN c b ON a.class_id < b.class_id AND bit_count(xor(a.signature, b.signature)) <= 3)"""
EDGES = "SELECT DISTINCT source_ids[1] AS parent_id, unnest(source_ids[2:]) AS child_id FROM release_mixture WHERE len(source_ids) > 1"
FAMILY = f"""e AS (SELECT * FROM ({EDGES}) WHERE parent_id <> child_id),
    up AS (SELECT child_id AS source_id, parent_id AS ancestor_id FROM e UNION SELECT u.source_id, e.parent_id FROM up u JOIN e ON u.ancestor_id = e.child_id),
    al AS (SELECT source_id, ancestor_id FROM up UNION SELECT source_id, source_id FROM up UNION SELECT ancestor_id, ancestor_id FROM up),
    fam AS (SELECT DISTINCT a.source_id, b.source_id AS relative_id FROM al a JOIN al b USING (ancestor_id) WHERE a.source_id <> b.source_id)"""
_APPROXIMATE = f"""{_SIG}, {_signature_sql("eval_items", "item_id").replace("t AS (", "t2 AS (").replace("FROM t ", "FROM t2 ").replace("g AS (", "g2 AS (").replace("FROM g,", "FROM g2,").replace("b AS (", "b2 AS (").replace("FROM b GROUP", "FROM b2 GROUP").replace("    s AS (", "    s2 AS (")},
    ap AS (SELECT s.doc_id, s2.item_id, bit_count(xor(s.signature, s2.signature))::BIGINT AS distance FROM s JOIN s2 ON bit_count(xor(s.signature, s2.signature)) <= 10
      AND len(list_filter(range(8), lambda i: ((s.signature >> (i * 8)) & 255) = ((s2.signature >> (i * 8)) & 255))) > 0),
    ar AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, item_id) AS k FROM ap)"""

_PAIRS = """ps AS (SELECT signature, row_number() OVER (ORDER BY sha256(doc_id::VARCHAR)) AS k FROM s QUALIFY k <= 2000), ph AS (SELECT bit_count(xor(a.signature, b.signature))::BIGINT AS distance, count(*) AS pairs FROM ps a JOIN ps b ON a.k < b.k GROUP BY 1)"""
_COPIES = f"""{perturbed_sql("documents", "doc_id")}, cg AS (SELECT doc_id, kind, n AS words, len(v) - 2 AS n, unnest(list_transform(range(1, len(v) - 1), lambda i: ('0x' || substr(md5(array_to_string(v[i:i + 2], chr(31))), 1, 16))::UBIGINT)) AS h FROM pt WHERE len(v) >= 5),
    cb AS (SELECT doc_id, kind, any_value(words) AS words, any_value(n) AS n, i, sum((h >> i) & 1) AS ones FROM cg, range(64) r(i) GROUP BY doc_id, kind, i),
    cs AS (SELECT doc_id, kind, any_value(words) AS words, sum(CASE WHEN 2 * ones > n THEN (1::UBIGINT << i)::HUGEINT ELSE 0 END)::UBIGINT AS other FROM cb GROUP BY doc_id, kind),
    cd AS (SELECT kind, CASE WHEN words < 50 THEN 'short' WHEN words < 150 THEN 'middle' ELSE 'long' END AS length, bit_count(xor(s.signature, other))::BIGINT AS distance FROM cs JOIN s USING (doc_id)),
    ch AS (SELECT kind, length, distance, count(*) AS copies FROM cd GROUP BY GROUPING SETS ((distance), (kind, distance), (length, distance)))"""

QUERIES = {
    "normalized_duplicates": (
        normalized_duplicates,
        """WITH d AS (SELECT DISTINCT source_id, fingerprint_version, normalized_sha256, source_ordinal FROM document_fingerprints WHERE normalized_sha256 IS NOT NULL), g AS (SELECT source_id, count(*) AS n FROM d GROUP BY source_id, fingerprint_version, normalized_sha256)
        SELECT source_id, sum(n)::BIGINT AS lines, sum(n - 1)::BIGINT AS surplus, count(*) FILTER (n > 1) AS groups FROM g GROUP BY source_id""",
    ),
    "cross_source_duplicates": (
        cross_source_duplicates,
        f"""WITH RECURSIVE {FAMILY},
        d AS (SELECT DISTINCT source_id, fingerprint_version, normalized_sha256, source_ordinal FROM document_fingerprints WHERE normalized_sha256 IS NOT NULL),
        k AS (SELECT DISTINCT source_id, fingerprint_version, normalized_sha256 FROM d),
        x AS (SELECT a.source_id, a.source_ordinal, b.source_id AS other FROM d a JOIN k b ON a.fingerprint_version = b.fingerprint_version AND a.normalized_sha256 = b.normalized_sha256 AND a.source_id <> b.source_id ANTI JOIN fam f ON f.source_id = a.source_id AND f.relative_id = b.source_id)
        SELECT source_id, count(DISTINCT source_ordinal) AS lines, count(DISTINCT other) AS sources FROM x GROUP BY source_id""",
    ),
    "lineage_family": (families, f"WITH RECURSIVE {FAMILY} SELECT source_id, relative_id FROM fam"),
    "exact_file_duplicates": (
        exact_file_duplicates,
        """WITH s AS (SELECT DISTINCT source_id, source_version, source_sha256, added_at FROM release_sources), f AS (SELECT *, first_value(source_id) OVER w AS c, first_value(source_version) OVER w AS v FROM s WINDOW w AS (PARTITION BY source_sha256 ORDER BY added_at, source_id, source_version))
        SELECT source_id, source_version, c AS canonical_id, v AS canonical_version, c <> source_id OR v <> source_version AS duplicate FROM f""",
    ),
    "first_seen_dedup": (
        first_seen_dedup,
        f"""WITH d AS (SELECT doc_id, CASE WHEN length({P}) >= 32 THEN sha256({P}) END AS fp FROM documents)
        SELECT doc_id, CASE WHEN fp IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY fp) END AS first_id, CASE WHEN fp IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY fp) END AS copies FROM d""",
    ),
    "exact_decontamination": (exact_decontamination, f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND sha256({P}) IN (SELECT sha256({P}) FROM eval_items)"),
    "simhash_md5": (simhash_md5, f"WITH {_SIG} SELECT doc_id, lpad(bin(signature), 64, '0') AS bits FROM s"),
    "simhash_blake2b": (simhash_blake2b, None),
    "near_duplicate_pairs": (near_duplicate_pairs, f"WITH {_NEAR} SELECT left_id, right_id, distance, (((64 - distance) * 10000 + 32) // 64)::BIGINT AS points FROM np"),
    "signature_classes": (signature_classes, f"WITH {_RSIG} SELECT doc_id, min(doc_id) OVER (PARTITION BY signature) AS class_id, count(*) OVER (PARTITION BY signature) AS copies FROM s"),
    "near_duplicate_resolution": (
        near_duplicate_resolution,
        f"""WITH RECURSIVE {_NEAR}, nl AS (SELECT right_id AS id, list(left_id) AS lefts FROM np GROUP BY right_id), no AS (SELECT id, lefts, row_number() OVER (ORDER BY id) AS k FROM nl),
        nr AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS dropped UNION ALL SELECT nr.k + 1, CASE WHEN len(list_filter(no.lefts, lambda x: NOT list_contains(nr.dropped, x))) > 0 THEN list_append(nr.dropped, no.id) ELSE nr.dropped END FROM nr JOIN no ON no.k = nr.k + 1)
        SELECT class_id, NOT list_contains((SELECT dropped FROM nr WHERE k = (SELECT max(k) FROM nr)), class_id) AS kept FROM c""",
    ),
    "near_duplicate_report": (
        near_duplicate_report,
        f"""WITH {_NEAR}, so AS (SELECT DISTINCT revision_id, source_id FROM document_revisions)
        SELECT distance, CASE WHEN a.source_id IS NOT DISTINCT FROM b.source_id THEN 'within' ELSE 'across' END AS relation, count(*) AS pairs FROM np JOIN so a ON a.revision_id = left_id JOIN so b ON b.revision_id = right_id GROUP BY ALL""",
    ),
    "closest_pairs": (closest_pairs, f"WITH {_NEAR} SELECT left_id, right_id, distance FROM np ORDER BY distance, left_id, right_id LIMIT 100"),
    "approximate_decontamination": (approximate_decontamination, f"WITH {_APPROXIMATE} SELECT doc_id, item_id, distance FROM ar WHERE k = 1"),
    "decontamination_gate": (
        decontamination_gate,
        f"""WITH {_APPROXIMATE}, n AS (SELECT count(*) AS refs FROM eval_items WHERE item_split IN ('eval', 'holdout') AND text IS NOT NULL),
        x AS (SELECT source, count(*) AS documents, count(*) FILTER (sha256({P}) IN (SELECT sha256({P}) FROM eval_items WHERE item_split IN ('eval', 'holdout'))) AS exact, count(*) FILTER (doc_id IN (SELECT doc_id FROM ar)) AS near FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY source)
        SELECT source, documents, exact, near, CASE WHEN refs = 0 THEN 'not_evaluated' WHEN exact + near > 0 THEN 'blocked' ELSE 'passed' END AS outcome FROM x, n""",
    ),
    "corpus_pair_histogram": (corpus_pair_histogram, f"WITH {_SIG}, {_PAIRS} SELECT distance, pairs FROM ph"),
    "perturbation_distances": (perturbation_distances, f"WITH {_SIG}, {_COPIES} SELECT kind, length, distance, copies FROM ch"),
    "threshold_sweep": (
        threshold_sweep,
        f"""WITH {_SIG}, {_PAIRS}, {_COPIES}, f AS (SELECT t.threshold, coalesce(pairs, 0) AS pairs, coalesce(copies, 0) AS copies FROM range(65) t(threshold) LEFT JOIN ph ON ph.distance = t.threshold LEFT JOIN (SELECT distance, copies FROM ch WHERE kind IS NULL AND length IS NULL) c ON c.distance = t.threshold),
        w AS (SELECT threshold, sum(pairs) OVER (ORDER BY threshold)::BIGINT AS pairs_within, sum(copies) OVER (ORDER BY threshold)::BIGINT AS copies_within, sum(pairs) OVER ()::BIGINT AS p, sum(copies) OVER ()::BIGINT AS c FROM f)
        SELECT threshold, pairs_within, ((pairs_within * 10000 + p // 2) // p)::BIGINT AS pair_points, copies_within, ((copies_within * 10000 + c // 2) // c)::BIGINT AS recall_points FROM w""",
    ),
}
