"""Each error code of canonical samples, and the text that valid ones teach."""

import copy
import json

import pytest

from sievewright.functions import canonical as C

TOOL = {"name": "find", "input_schema": {"type": "object"}}
BASE = {
    "schema_version": C.RULES.version, "record_type": "conversation", "sample_id": "s", "content_purpose": "instruction", "tools": [TOOL],
    "messages": [
        {"role": "user", "content": "soru"}, {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "name": "find", "arguments": {"q": 1}}]}, {"role": "tool", "tool_call_id": "c1", "content": "sonuç"},
        {"role": "assistant", "content": [{"type": "text", "text": "yanıt"}, {"type": "image", "url": "u"}], "reasoning_content": "gizli", "reasoning_visibility": "review_only"},
    ],
}
PAIR = {"schema_version": C.RULES.version, "record_type": "preference", "sample_id": "p", "content_purpose": "preference", "messages": [{"role": "user", "content": "q"}], "preference": {"chosen": [{"role": "assistant", "content": "a"}], "rejected": [{"role": "assistant", "content": "b"}]}}


def changed(base, *path_value):
    made = copy.deepcopy(base)
    *path, last, value = path_value
    at = made
    for k in path:
        at = at[k]
    if value is KeyError:
        del at[last]
    else:
        at[last] = value
    return made


def error(sample, purpose=None):
    return C.sample_of(json.dumps(sample), purpose or sample["content_purpose"]).error


CASES = [
    (("schema_version", "other"), "unsupported_schema_version"), (("odd", 1), "sample_unknown_fields:odd"), (("record_type", " "), "sample_record_type_required"), (("record_type", "x"), "invalid_record_type"), (("sample_id", KeyError), "sample_sample_id_required"),
    (("content_purpose", ""), "sample_content_purpose_required"), (("content_purpose", "x"), "invalid_content_purpose"), (("task_type", ""), "sample_task_type_must_be_string"), (("created_by", 3), "sample_created_by_must_be_string"), (("train_policy", "x"), "invalid_train_policy"),
    (("metadata", []), "sample_metadata_must_be_object"), (("tools", {}), "tools_must_be_array"), (("tools", [1]), "tool_0_must_be_object"), (("tools", 0, "x", 1), "tool_0_unknown_fields:x"), (("tools", 0, "name", ""), "tool_0_name_required"), (("tools", [TOOL, TOOL]), "duplicate_tool_name"),
    (("tools", 0, "input_schema", "x"), "tool_0_input_schema_required"), (("tools", 0, "strict", 1), "tool_0_strict_must_be_boolean"), (("tools", 0, "description", ""), "tool_0_description_must_be_string"), (("preference", {}), "conversation_has_preference"), (("messages", []), "conversation_messages_required"),
    (("messages", 0, "x"), "message_0_must_be_object"), (("messages", 0, "odd", 1), "message_0_unknown_fields:odd"), (("messages", 0, "role", KeyError), "message_0_role_required"), (("messages", 0, "role", "king"), "message_0_invalid_role"), (("messages", 0, "name", ""), "message_0_name_must_be_string"),
    (("messages", 0, "metadata", 1), "message_0_metadata_must_be_object"), (("messages", 0, "content", 4), "message_0_invalid_content"), (("messages", 3, "content", 0, 5), "message_3_part_0_must_be_object"), (("messages", 3, "content", 0, "x", 5), "message_3_part_0_unknown_fields:x"),
    (("messages", 3, "content", 0, "type", "x"), "message_3_part_0_invalid_type"), (("messages", 3, "content", 0, "text", KeyError), "message_3_part_0_text_required"), (("messages", 3, "content", 1, "url", KeyError), "message_3_part_1_asset_required"), (("messages", 3, "content", 1, "mime_type", 1), "message_3_part_1_mime_type_must_be_string"),
    (("messages", 3, "reasoning_content", ""), "message_3_reasoning_must_be_string"), (("messages", 3, "reasoning_visibility", KeyError), "message_3_reasoning_visibility_required"), (("messages", 0, "reasoning_visibility", "x"), "message_0_invalid_reasoning_visibility"), (("messages", 1, "tool_calls", {}), "message_1_tool_calls_must_be_array"),
    (("messages", 1, "role", "user"), "message_1_tool_calls_require_assistant"), (("messages", 1, "tool_calls", 0, 1), "message_1_tool_call_0_must_be_object"), (("messages", 1, "tool_calls", 0, "id", ""), "message_1_tool_call_0_id_required"), (("messages", 1, "tool_calls", 0, "name", "x"), "tool_call_references_unknown_tool"),
    (("messages", 1, "tool_calls", 0, "arguments", "x"), "tool_call_arguments_must_be_object"), (("messages", 1, "tool_calls", BASE["messages"][1]["tool_calls"] * 2), "duplicate_tool_call_id"), (("messages", 2, "tool_call_id", KeyError), "message_2_tool_call_id_required"),
    (("messages", 0, "tool_call_id", "c1"), "message_0_tool_call_id_requires_tool_role"), (("messages", 2, "tool_call_id", "c9"), "tool_result_references_unknown_call"),
]
PAIR_CASES = [
    (("content_purpose", "instruction"), "preference_record_requires_preference_purpose"), (("messages", {}), "preference_context_must_be_messages"), (("preference", []), "preference_branches_required"), (("preference", "x", 1), "preference_unknown_fields:x"),
    (("preference", "chosen", KeyError), "preference_chosen_and_rejected_required"), (("preference", "rejected", []), "preference_rejected_required"), (("preference", "rejected", [{"role": "assistant", "content": "a", "message_id": "m"}]), "preference_branches_identical"),
    (("preference", "rejected", [{"role": "assistant", "content": "a", "reasoning_content": "r", "reasoning_visibility": "review_only"}]), "preference_branches_identical"), (("preference", "rejected", [{"role": "assistant", "content": "a", "reasoning_content": "r", "reasoning_visibility": "export_allowed"}]), None),
]


@pytest.mark.parametrize(("change", "code"), CASES)
def test_conversation_errors(change, code):
    assert error(changed(BASE, *change)) == code


@pytest.mark.parametrize(("change", "code"), PAIR_CASES)
def test_preference_errors(change, code):
    assert error(changed(PAIR, *change)) == code


def test_what_is_no_sample():
    assert C.sample_of("x", "eval") is None and C.sample_of(None, "eval") is None and C.sample_of('{"a": 1}', "eval") is None and C.sample_of("[1]", "eval") is None
    assert error(BASE, "eval") == "content_purpose_mismatch" and error(BASE) is None and error(PAIR) is None


def test_semantic_text(spark):
    rows = spark.createDataFrame([(1, json.dumps(BASE)), (2, "x"), (3, None), (4, json.dumps(changed(BASE, "odd", 1))), (5, json.dumps(PAIR))], "id long, line string")
    got = {r["id"]: r["v"] for r in rows.select("id", C.validated(rows["line"], "instruction").alias("v")).collect()}
    assert got[1]["semantic_text"].split("\n") == ["find", '{"type":"object"}', "soru", "find", '{"q":1}', "sonuç", "yanıt"]  # reasoning for review is left out
    assert not got[2]["is_sample"] and not got[3]["is_sample"] and got[4]["error"] == "sample_unknown_fields:odd" and got[5]["error"] == "content_purpose_mismatch"
    assert C.sample_of(json.dumps(PAIR), "preference").texts == ["q", "a", "q", "b"]  # the context belongs to both branches
