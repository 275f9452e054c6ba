"""Canonical samples: closed-world validation with stable error codes, and the text that a sample teaches.

A sample is a JSON object with a schema version; other lines are no samples.
Checks are tables of (test, code) over each part of a sample; the code of the
first that fails is the sample's error. Reasoning that is for review only is
left out of what a sample teaches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.tables import table

#: The fields of each part, and the values of closed fields.
FIELDS = {
    "sample": "schema_version record_type sample_id content_purpose task_type language domain train_policy created_at created_by messages tools preference metadata".split(),
    "message": "message_id role name content reasoning_content reasoning_visibility tool_calls tool_call_id metadata".split(),
    "part": "type text asset_ref url mime_type metadata".split(),
    "tool": "name description input_schema strict defer_loading".split(),
    "call": "id name arguments".split(),
    "preference": "chosen rejected".split(),
}
RECORD_TYPES = ("conversation", "preference")
SIGNAL = ("role", "name", "content", "reasoning_content", "tool_calls", "tool_call_id")


class Rules:
    """The schema version and the values of the closed fields; each is a parameter, as they belong to a project."""

    def __init__(self, version: str, purposes: str, policies: str, roles: str, visibilities: str, parts: str):
        self.version = version
        self.purposes, self.policies, self.roles, self.visibilities, self.parts = (frozenset(x.split()) for x in (purposes, policies, roles, visibilities, parts))


#: Fixed values of the closed fields; the version is the project's own.
RULES = Rules(
    "canonical-sample.v1",
    "pretrain instruction preference eval holdout post_training",
    "assistant_only full_dialogue no_train eval_only",
    "system developer user assistant tool other",
    "hidden review_only export_allowed",
    "text image image_url video video_url audio audio_url tool_reference",
)


def said(value: Any) -> bool:
    return isinstance(value, str) and bool(value.strip())


def form(obj: dict, kind: str, where: str, required: str = "", strings: str = "", objects: str = "") -> Iterator[tuple[bool, str]]:
    """(holds, code) of a part's fields."""
    unknown = sorted(set(obj) - set(FIELDS[kind]))
    yield not unknown, f"{where}_unknown_fields:{','.join(unknown)}"
    yield from ((said(obj.get(k)), f"{where}_{k}_required") for k in required.split())
    yield from ((k not in obj or said(obj[k]), f"{where}_{k}_must_be_string") for k in strings.split())
    yield from ((k not in obj or isinstance(obj[k], dict), f"{where}_{k}_must_be_object") for k in objects.split())


class Sample:
    """One sample with the first error that its checks meet."""

    def __init__(self, obj: dict, purpose: str, rules: Rules = RULES):
        self.obj, self.purpose, self.rules = obj, purpose, rules
        self.texts: list[str] = []
        self.error = next((code for holds, code in self._checks() if not holds), None)

    def _checks(self) -> Iterator[tuple[bool, str]]:
        obj, rules = self.obj, self.rules
        yield obj.get("schema_version") == rules.version, "unsupported_schema_version"
        kind, purpose = obj.get("record_type"), obj.get("content_purpose")
        named = list(form(obj, "sample", "sample", "record_type sample_id content_purpose", "task_type language domain created_at created_by", "metadata"))
        unknown, record, ident, purposed, *rest, metadata = named
        yield from (unknown, record, (kind in RECORD_TYPES, "invalid_record_type"), ident, purposed)
        yield purpose in rules.purposes, "invalid_content_purpose"
        yield purpose == self.purpose, "content_purpose_mismatch"
        yield from rest
        yield obj.get("train_policy") is None or obj["train_policy"] in rules.policies, "invalid_train_policy"
        yield metadata
        tools: set[str] = set()
        yield from self._tools(obj.get("tools", []), tools)
        messages = obj.get("messages")
        if kind == "conversation":
            yield "preference" not in obj, "conversation_has_preference"
            yield isinstance(messages, list) and bool(messages), "conversation_messages_required"
            yield from self._messages(messages, tools, keep=len(messages))
            return
        context, pair = obj.get("messages", []), obj.get("preference")
        yield purpose == "preference", "preference_record_requires_preference_purpose"
        yield isinstance(context, list), "preference_context_must_be_messages"
        yield isinstance(pair, dict), "preference_branches_required"
        yield next(form(pair, "preference", "preference"))
        yield set(pair) == set(FIELDS["preference"]), "preference_chosen_and_rejected_required"
        yield from self._messages(context, tools, keep=0)
        for branch in FIELDS["preference"]:
            yield isinstance(pair[branch], list) and bool(pair[branch]), f"preference_{branch}_required"
            yield from self._messages(context + pair[branch], tools, keep=len(context) + len(pair[branch]))
        yield self._signal(pair["chosen"]) != self._signal(pair["rejected"]), "preference_branches_identical"

    @staticmethod
    def _signal(messages: list[dict]) -> list[dict]:
        hidden = lambda m, k: k == "reasoning_content" and m.get("reasoning_visibility") != "export_allowed"
        return [{k: m[k] for k in SIGNAL if k in m and not hidden(m, k)} for m in messages]

    def _tools(self, tools: Any, names: set[str]) -> Iterator[tuple[bool, str]]:
        yield isinstance(tools, list), "tools_must_be_array"
        for i, tool in enumerate(tools):
            where = f"tool_{i}"
            yield isinstance(tool, dict), f"{where}_must_be_object"
            yield from form(tool, "tool", where, "name")
            yield tool["name"] not in names, "duplicate_tool_name"
            yield isinstance(tool.get("input_schema"), dict), f"{where}_input_schema_required"
            yield from ((k not in tool or isinstance(tool[k], bool), f"{where}_{k}_must_be_boolean") for k in ("strict", "defer_loading"))
            about = tool.get("description")
            yield about is None or said(about), f"{where}_description_must_be_string"
            names.add(tool["name"])
            self.texts += [x for x in (tool["name"], about, compact(tool["input_schema"])) if x]

    def _messages(self, messages: list, tools: set[str], keep: int) -> Iterator[tuple[bool, str]]:
        calls, results = set(), []
        for i, m in enumerate(messages):
            where, texts = f"message_{i}", []
            yield isinstance(m, dict), f"{where}_must_be_object"
            unknown, role, *rest = form(m, "message", where, "role", "message_id name", "metadata")
            yield from (unknown, role, (m.get("role") in self.rules.roles, f"{where}_invalid_role"), *rest)
            texts.append(m.get("name"))
            yield from self._content(m.get("content"), where, texts)
            thought, seen = m.get("reasoning_content"), m.get("reasoning_visibility")
            if thought is not None:
                yield said(thought), f"{where}_reasoning_must_be_string"
                yield seen in self.rules.visibilities, f"{where}_reasoning_visibility_required"
                texts.append(thought if seen == "export_allowed" else None)
            yield seen is None or seen in self.rules.visibilities, f"{where}_invalid_reasoning_visibility"
            own = m.get("tool_calls", [])
            yield isinstance(own, list), f"{where}_tool_calls_must_be_array"
            yield not own or m["role"] == "assistant", f"{where}_tool_calls_require_assistant"
            for k, call in enumerate(own):
                at = f"{where}_tool_call_{k}"
                yield isinstance(call, dict), f"{at}_must_be_object"
                yield from form(call, "call", at, "id name")
                yield call["id"] not in calls, "duplicate_tool_call_id"
                yield call["name"] in tools, "tool_call_references_unknown_tool"
                yield isinstance(call.get("arguments"), dict), "tool_call_arguments_must_be_object"
                calls.add(call["id"])
                texts += [call["name"], compact(call["arguments"])]
            answers = m.get("tool_call_id")
            if m["role"] == "tool":
                yield said(answers), f"{where}_tool_call_id_required"
                results.append(answers)
            else:
                yield answers is None, f"{where}_tool_call_id_requires_tool_role"
            if i < keep:
                self.texts += [t for t in texts if t]
        yield calls.issuperset(results), "tool_result_references_unknown_call"

    def _content(self, content: Any, where: str, texts: list) -> Iterator[tuple[bool, str]]:
        if content is None or isinstance(content, str):
            texts.append(content)
            return
        yield isinstance(content, list), f"{where}_invalid_content"
        for i, part in enumerate(content):
            at = f"{where}_part_{i}"
            yield isinstance(part, dict), f"{at}_must_be_object"
            unknown, typed, *rest = form(part, "part", at, "type", "text asset_ref url mime_type", "metadata")
            yield from (unknown, typed, (part.get("type") in self.rules.parts, f"{at}_invalid_type"), *rest)
            if part["type"] == "text":
                yield isinstance(part.get("text"), str) and part["text"] != "", f"{at}_text_required"
                texts.append(part["text"])
            else:
                yield bool(part.get("asset_ref") or part.get("url")), f"{at}_asset_required"


def compact(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sample_of(line: str | None, purpose: str, rules: Rules = RULES) -> Sample | None:
    """None for a line that is no sample."""
    try:
        obj = json.loads(line) if line is not None else None
    except (ValueError, RecursionError):
        return None
    return Sample(obj, purpose, rules) if isinstance(obj, dict) and "schema_version" in obj else None


def validated(line: Column, purpose: str, rules: Rules = RULES) -> Column:
    """Struct of a line: whether it is a sample, its error, and the text that it teaches."""

    @F.pandas_udf("is_sample boolean, error string, semantic_text string")
    def check(lines: pd.Series) -> pd.DataFrame:
        made = [sample_of(x, purpose, rules) for x in lines]
        texts = [None if s is None or s.error else "\n".join(s.texts) for s in made]
        return pd.DataFrame({"is_sample": [s is not None for s in made], "error": [s.error if s else None for s in made], "semantic_text": texts})

    return check(line)


def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, line): the conversations as canonical samples; a call's tool is declared, so only its results can be wrong."""
    c = table(spark, sf_dir, "canonical_conversations").dropDuplicates(["sample_id"])
    call = lambda m: (m["message_role"] == "assistant") & m["tool_call_id"].isNotNull()
    message = lambda m: F.struct(
        m["message_role"].alias("role"), m["content_text"].alias("content"),
        F.when(call(m), F.array(F.struct(m["tool_call_id"].alias("id"), F.lit("tool").alias("name"), F.struct(F.lit(1).alias("n")).alias("arguments")))).alias("tool_calls"),
        F.when(~call(m), m["tool_call_id"]).alias("tool_call_id"),
    )
    tools = F.array(F.struct(F.lit("tool").alias("name"), F.struct(F.lit("object").alias("type")).alias("input_schema")))
    whole = F.struct(F.lit(RULES.version).alias("schema_version"), F.lit("conversation").alias("record_type"), "sample_id", F.lit("instruction").alias("content_purpose"), "task_type", F.transform("messages", message).alias("messages"), tools.alias("tools"))
    return c.select("sample_id", F.to_json(whole).alias("line"))


def canonical_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of each canonical sample, or the hash of the text that it teaches."""
    v = canonical_lines(spark, sf_dir).select("sample_id", validated(F.col("line"), "instruction").alias("v"))
    return v.select("sample_id", "v.error", F.md5("v.semantic_text").alias("text_md5"))


_CALL = "m.message_role = 'assistant' AND m.tool_call_id IS NOT NULL"
QUERIES = {
    "canonical_samples": (
        canonical_samples,
        f"""WITH c AS (SELECT DISTINCT ON (sample_id) * FROM canonical_conversations), x AS (SELECT sample_id, messages, list_transform(list_filter(messages, lambda m: {_CALL}), lambda m: m.tool_call_id) AS calls, list_transform(list_filter(messages, lambda m: m.message_role = 'tool'), lambda m: m.tool_call_id) AS results,
          list_filter(list_transform(range(1, len(messages) + 1), lambda i: CASE WHEN messages[i].message_role = 'tool' AND coalesce(trim(messages[i].tool_call_id), '') = '' THEN 'message_' || (i - 1) || '_tool_call_id_required' WHEN messages[i].message_role NOT IN ('tool', 'assistant') AND messages[i].tool_call_id IS NOT NULL THEN 'message_' || (i - 1) || '_tool_call_id_requires_tool_role' END), lambda e: e IS NOT NULL) AS bad,
          list_filter(flatten(list_transform(messages, lambda m: CASE WHEN {_CALL} THEN [m.content_text, 'tool', '{{"n":1}}'] ELSE [m.content_text] END)), lambda t: t <> '') AS said FROM c),
        e AS (SELECT *, CASE WHEN len(messages) = 0 OR messages IS NULL THEN 'conversation_messages_required' WHEN len(bad) > 0 THEN bad[1] WHEN len(calls) > len(list_distinct(calls)) THEN 'duplicate_tool_call_id' WHEN len(list_filter(results, lambda r: NOT list_contains(calls, r))) > 0 THEN 'tool_result_references_unknown_call' END AS error FROM x)
        SELECT sample_id, error, CASE WHEN error IS NULL THEN md5('tool' || chr(10) || '{{"type":"object"}}' || CASE WHEN len(said) > 0 THEN chr(10) || array_to_string(said, chr(10)) ELSE '' END) END AS text_md5 FROM e""",
    ),
}
