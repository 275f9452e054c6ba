import hashlib
import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.functions import stats as S
from sievewright.functions import text as T
from sievewright.operators import dedup, review


def one(spark, column, **values):
    types = {int: "long", str: "string", float: "double"}
    row = [tuple(values.values())]
    schema = ", ".join(f"{k} {types[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame(row, schema).select(column.alias("x")).first()["x"]


def test_normalize_text(spark):
    assert one(spark, T.normalize_text("t"), t="ﬁne  ＡBC\tStraße ") == "fine abc strasse"
    assert one(spark, T.normalize_text("t"), t=None) is None
    assert one(spark, T.normalize_text("t"), t="") == ""


def test_fingerprint_edge(spark):
    assert one(spark, T.fingerprint(F.col("t")), t="x" * 31) is None
    assert one(spark, T.fingerprint(F.col("t")), t="x" * 32) == hashlib.sha256(b"x" * 32).hexdigest()


def test_check_digits(spark):
    assert one(spark, T.national_id_valid(F.col("t")), t="10000000146") is True
    assert one(spark, T.national_id_valid(F.col("t")), t="10000000147") is False
    assert not one(spark, T.national_id_valid(F.col("t")), t="abc")
    assert one(spark, T.luhn_valid(F.col("t")), t="4111111111111111") is True
    assert one(spark, T.luhn_valid(F.col("t")), t="0000000000000000") is False
    assert one(spark, T.luhn_valid(F.col("t")), t="411111111111") is False
    assert one(spark, T.iban_valid(F.col("t")), t="TR330006100519786457841326") is True
    assert one(spark, T.iban_valid(F.col("t")), t="TR340006100519786457841326") is False


def test_ngrams_short(spark):
    d = spark.createDataFrame([(["a", "b"],), (["a", "b", "c", "d"],), ([],)], "w array<string>")
    assert [r[0] for r in d.select(T.ngrams(F.col("w"), 3)).collect()] == [[], ["a\x1fb\x1fc", "b\x1fc\x1fd"], []]


def naive_simhash(text):
    words = text.split()
    grams = ["\x1f".join(words[i : i + 3]) for i in range(len(words) - 2)]
    votes = [0] * 64
    for g in grams:
        h = int.from_bytes(hashlib.md5(g.encode()).digest()[:8], "big")
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_simhash_against_naive(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(5, 40))) for _ in range(40)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.simhash(digest="md5")("t").alias("s")).collect()
    assert [r["s"] % (1 << 64) for r in got] == [naive_simhash(t) for t in texts]
    assert one(spark, T.simhash()("t"), t="only four words here") is None


def test_near_pairs_are_complete(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    sigs = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))) for b in base]
    signed = [s - (1 << 64) if s >= 1 << 63 else s for s in sigs]
    got = {(r["left_id"], r["right_id"]) for r in dedup.near_pairs(spark.createDataFrame(list(enumerate(signed)), "doc_id long, signature long")).collect()}
    assert got == {(i, j) for i, j in combinations(range(len(sigs)), 2) if sigs[i] != sigs[j] and (sigs[i] ^ sigs[j]).bit_count() <= 3}


def test_greedy_resolution_of_a_long_chain(spark):
    pairs = spark.range(69).selectExpr("id as left_id", "id + 1 as right_id").coalesce(1)
    state = dedup.greedy_resolution(pairs, spark.range(70).withColumnRenamed("id", "class_id").coalesce(1))
    assert {r["class_id"]: r["kept"] for r in state.collect()} == {i: i % 2 == 0 for i in range(70)}


def test_greedy_resolution_of_a_cycle(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "left_id long, right_id long")
    with pytest.raises(ValueError, match="2 classes stay open"):
        dedup.greedy_resolution(pairs, spark.createDataFrame([(1,), (2,)], "class_id long"))


def test_greedy_resolution(spark):
    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    kept = []
    for n in range(40):
        if not any((k, n) in edges for k in kept):
            kept.append(n)
    pairs = spark.createDataFrame(edges, "left_id long, right_id long")
    state = dedup.greedy_resolution(pairs, spark.range(40).withColumnRenamed("id", "class_id"))
    assert sorted(r["class_id"] for r in state.where("kept").collect()) == kept


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent_id string, child_id string")
    got = {tuple(r) for r in dedup.relatives(e).collect()}
    assert got == {(p, q) for p in "abc" for q in "abc" if p != q} | {("x", "y"), ("y", "x")}
    assert {tuple(r) for r in dedup.closure(e).where("source_id = 'y'").collect()} == {("y", "x")}


def test_relatives_share_an_ancestor(spark):
    e = spark.createDataFrame([("root", "a"), ("root", "b"), ("a", "c"), ("far", "d"), (None, "z")], "parent_id string, child_id string")
    got = {tuple(r) for r in dedup.relatives(e).collect()}
    family = {"root", "a", "b", "c"}
    assert got == {(p, q) for p in family for q in family if p != q} | {("far", "d"), ("d", "far")}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)], "parent_id string, child_id string")
    assert dedup.closure(chain).count() == 40 * 41 // 2


def test_all_children_are_edges(spark, tmp_path):
    spark.createDataFrame([("r", [f"s{i}" for i in range(1002)])], "release_id string, source_ids array<string>").write.parquet(str(tmp_path / "release_mixture.parquet"))
    assert dedup.edges(spark, str(tmp_path)).count() == 1001


def test_late_system_message_at_any_place(spark, tmp_path):
    from sievewright.operators import records

    message = lambda role: (role, "x", None)
    talk = [message("user"), *[message("assistant")] * 100_001, message("system")]
    schema = "sample_id string, messages array<struct<message_role string, content_text string, tool_call_id string>>"
    spark.createDataFrame([("a", talk), ("b", []), ("c", None), ("d", talk[:3])], schema).write.parquet(str(tmp_path / "canonical_conversations.parquet"))
    got = {r["sample_id"]: r["errors"] for r in records.conversation_errors(spark, str(tmp_path)).collect()}
    assert got["a"] == "late_system" and got["d"] == "" and "no_messages" in got["b"]


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from sievewright import tables

    conf = SimpleNamespace(get=lambda *a: "")
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_nearest_items_against_plain_search(spark, monkeypatch):
    rng = random.Random(11)
    items = [rng.getrandbits(63) for _ in range(40)]
    sigs = [x ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 14))) for x in items for _ in range(5)]
    monkeypatch.setattr(dedup, "ITEM_SIGNATURES", 16)
    a = spark.createDataFrame([(s,) for s in sigs], "signature long")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, signature long")
    got = {r["signature"]: (r["distance"], r["item"]) for r in dedup.nearest_items(a, b, "item_id").collect()}
    want = {}
    for s in sigs:
        close = [((s ^ x).bit_count(), i) for i, x in enumerate(items) if (s ^ x).bit_count() <= 10 and any(((s ^ x) >> (8 * k)) & 255 == 0 for k in range(8))]
        if close:
            want[s] = min(close)
    assert got == want


def test_exact_decontamination_finds_planted_items(spark, tmp_path):
    items = [(1, "Bir DENEME  metni", "eval"), (2, "baska", "train"), (3, None, "eval")]
    docs = [(7, "bir deneme\nmetni", "s"), (8, "BASKA", "s"), (9, "bir deneme metni x", "t"), (10, None, "t")]
    spark.createDataFrame(items, "item_id long, text string, item_split string").write.parquet(str(tmp_path / "eval_items.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["doc_id"] for r in dedup.exact_decontamination(spark, str(tmp_path)).collect()] == [7]
    assert {r["source"]: (r["outcome"], r["exact"]) for r in dedup.decontamination_gate(spark, str(tmp_path)).collect()} == {"s": ("blocked", 1), "t": ("passed", 0)}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(3, 20))
def test_pack_text(text, limit):
    pieces = T.pack_text(text, limit)
    assert all(0 < len(p) <= limit for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())


def test_lz77():
    assert T.lz77_permille_of("") == 1000 and T.lz77_permille_of(None) is None
    assert T.lz77_permille_of("abcdefghijkl") == 14 * 1000 // 12  # 108 bits are 14 bytes
    assert T.lz77_permille_of("abcd" * 500) < 100


def test_wilson_and_kappa(spark):
    w = one(spark, S.wilson(F.col("k"), F.col("n")), k=5, n=10)
    assert abs(w["low"] - 0.2366) < 1e-4 and abs(w["high"] - 0.7634) < 1e-4
    assert one(spark, S.wilson(F.col("k"), F.col("n")), k=0, n=0)["low"] is None
    assert one(spark, S.kappa(F.col("o"), F.col("e")), o=1.0, e=1.0) is None
    assert one(spark, S.kappa(F.col("o"), F.col("e"), F.lit(1.0)), o=1.0, e=1.0) == 1.0


def test_reservoir():
    kept = review.reservoir_indices(1000, 10, "9f86d081884c7d65")
    assert sorted(kept) == list(range(10)) and len(set(kept.values())) == 10 and all(1 <= v <= 1000 for v in kept.values())
    assert review.reservoir_indices(3, 10, "9f86d081884c7d65") == {0: 1, 1: 2, 2: 3} and review.reservoir_indices(0, 10, "0") == {}
    tenth = [sum(v <= 100 for v in review.reservoir_indices(1000, 10, f"{i:016x}").values()) for i in range(400)]
    assert 0.85 < sum(tenth) / 400 < 1.15  # each row is as likely as any other
    assert len(review.reservoir_indices(10**12, 50, "1")) == 50


def test_positions_of_a_hot_group(spark):
    rng = random.Random(8)
    data = [("hot" if i % 3 else rng.choice(["a", "b"]), rng.randint(0, 50), i) for i in range(3000)] + [(None, 1, 9000), (None, 0, 9001)]
    from sievewright.tables import positions

    df = spark.createDataFrame(data, "g string, o long, id long")
    want = {}
    for g in ("hot", "a", "b", None):
        for k, row in enumerate(sorted(r[1:] for r in data if r[0] == g), 1):
            want[row[1]] = k
    got = positions(df, "g", ["o", "id"], "position")
    assert {r["id"]: r["position"] for r in got.collect()} == want and got.columns == ["g", "o", "id", "position"]
