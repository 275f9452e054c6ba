"""Sheets, lists and bound tables come back as they were written, and wrong ones are refused."""

import json

import pytest
from pyspark.sql import functions as F

from sievewright.sources import lines, sheets

H = ["a" * 64, "b" * 64, "c" * 64]


def test_sheet_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(H[0], "x, \"y\"\nz", None), (H[1], "ü", " Keep ")], "sha256 string, preview string, verdict string")
    path = str(tmp_path / "sheet.csv")
    digest = sheets.write_sheet(d, path, ["sha256"], {"stratum": "short records=2"})
    assert digest == sheets.write_sheet(d, path, ["sha256"], {"stratum": "short records=2"})
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf# stratum: short records=2\n")
    rows, headers = sheets.read_sheet(spark, path)
    assert headers == {"stratum": "short records=2"}
    assert sorted((r["sha256"], r["preview"], r["verdict"]) for r in rows.collect()) == [(H[0], 'x, "y"\nz', None), (H[1], "ü", "keep")]
    sheets.write_sheet(d.union(d), path, ["sha256"])
    with pytest.raises(ValueError, match="listed twice"):
        sheets.read_sheet(spark, path)


def test_a_sheet_is_never_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "SHEET_LIMIT", 3)
    with pytest.raises(ValueError, match="at most 3"):
        sheets.write_sheet(spark.range(4), str(tmp_path / "x.csv"), ["id"])


def test_verdicts(spark, tmp_path):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "no long")
    path = tmp_path / "v.jsonl"
    path.write_text('{"no": 1, "verdict": "good"}\n\n{"no": 3, "verdict": "junk", "reason": "x"}\n')
    got, missing = sheets.read_verdicts(spark, str(path), asked)
    assert sorted((r["no"], r["verdict"]) for r in got.collect()) == [(1, "good"), (3, "junk")] and [r["no"] for r in missing.collect()] == [2]
    path.write_text('{"no": 9}\n')
    with pytest.raises(ValueError, match="unknown number: 9"):
        sheets.read_verdicts(spark, str(path), asked)
    path.write_text('{"no": 1}\n{"no": 1}\n')
    with pytest.raises(ValueError, match="twice: 1"):
        sheets.read_verdicts(spark, str(path), asked)


def test_drop_list(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text(json.dumps({"sha256": H[0].upper(), "reason": "old"}) + "\n" + json.dumps({"sha256": H[0], "reason": "new", "p": 0.5}) + "\n")
    (row,) = sheets.read_drop_list(spark, str(path)).collect()
    assert (row["sha256"], row["reason"], json.loads(row["details"])["p"]) == (H[0], "new", 0.5)
    path.write_text('{"sha256": "zz"}\n')
    with pytest.raises(ValueError, match="no hash"):
        sheets.read_drop_list(spark, str(path))


def test_bound_tables(spark, tmp_path):
    one, two = sheets.policy_identity([("a", "1")]), sheets.policy_identity([("a", "2")])
    assert one != two and one == sheets.policy_identity([("a", "1")])
    sheets.write_bound(spark.range(3), str(tmp_path), one)
    assert sheets.read_bound(spark, str(tmp_path), one).count() == 3 and sheets.read_bound(spark, str(tmp_path), two) is None


def test_legacy_lines_and_canonical_pass(spark):
    d = spark.createDataFrame([(1, '{"text": " a ", "url": "u"}'), (2, "  "), (3, "plain"), (4, '{"content": "c", "provenance": {"url": "p"}}'), (5, None), (6, '{"cut')], "source_ordinal long, line string")
    got = {r["source_ordinal"]: (r["text"], r["url"]) for r in sheets.legacy_documents(d, "s").collect()}
    assert got == {1: ("a", "u"), 3: ("plain", None), 4: ("c", "p"), 6: ('{"cut', None)}
    c = spark.createDataFrame([('{"schema_version": "1", "messages": []}',), ('{"schema_version": "1", "odd": 1}',), ("x",), (None,)], "line string")
    assert [r["problems"] for r in sheets.canonical_pass(c).collect()] == ["", "unknown_field|no_messages", "not_an_object", "not_an_object"]


def test_export_keeps_all_fields(spark, tmp_path):
    d = spark.createDataFrame([(2, "b", None), (1, "a", "tr"), (3, "c\n", "en")], "source_ordinal long, text string, lang string")
    facts = sheets.write_export(d, str(tmp_path / "out"), ["source_ordinal"]).collect()
    assert sum(r["records"] for r in facts) == 3
    back = lines.read_lines(spark, sorted(str(p) for p in (tmp_path / "out").glob("part-*"))).orderBy("source_ordinal").collect()
    assert [json.loads(r["line"]) for r in back] == [{"lang": "tr", "source_ordinal": 1, "text": "a"}, {"lang": None, "source_ordinal": 2, "text": "b"}, {"lang": "en", "source_ordinal": 3, "text": "c\n"}]


def test_card(spark):
    assert sheets.card_front_matter({"b": ["x", 1], "a": "ü"}) == '---\na: "ü"\nb:\n- "x"\n- 1\n---\n'


def test_equal_names_in_two_folders(spark, tmp_path):
    for k, text in (("one", "a\nb\n"), ("two", "c\n")):
        (tmp_path / k).mkdir()
        (tmp_path / k / "part-00000").write_text(text)
    got = lines.read_lines(spark, [str(tmp_path / "two" / "part-00000"), str(tmp_path / "one" / "part-00000")]).orderBy("source_ordinal").select(F.col("line")).collect()
    assert [r["line"] for r in got] == ["c", "a", "b"]


RISKY = {
    1: ("short_text", "kısa"), 2: ("long_text", "ab " * 1500), 3: ("control_characters", "harf​ ile yazılmış bir satır daha"), 4: ("high_symbol_ratio", "a#b$c%d^e&f*g(h)i_j+k=l{m}n[o]p|q:r;s<t>u?"),
    5: ("repeated_character_run", "çok uzuuuuuuuuuun bir satır yazdık"), 6: ("low_lexical_diversity", "evet " * 24), 7: ("identifier_pattern", "numarası 12345678901 olan bir kayıt"), 8: ("malformed_json", '{"text": "yarıda kalan bir satır'), 9: ("missing_text_field", '{"baslik": "metni olmayan bir nesne"}'),
}


def test_each_risk_reason(spark, tmp_path):
    from sievewright.operators import review

    spark.createDataFrame([(k, v) for k, (_, v) in RISKY.items()], "record_id long, raw_line string").write.parquet(str(tmp_path / "source_lines.parquet"))
    got = {r["record_id"]: r["reasons"].split("|") for r in review.risk_score(spark, str(tmp_path)).collect()}
    assert all(RISKY[k][0] in got[k] for k in RISKY), got
