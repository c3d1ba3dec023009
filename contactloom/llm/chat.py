"""Chat formatting with tool-call linking.

An assistant's message may hold tool calls, a tool's message a result:

* ``{"content": .., "tool_calls": [{"id", "name" or "function": {"name", "arguments"}, "arguments"}]}``
* ``{"tool_call_id": .., "content": ..}``

Anything else is plain text. Calls and results are joined by conversation and
identifier, calls of a message are put in topological order of what their
arguments refer to (``"${id}"`` stands for the result of that call), arguments
are validated against schemas, and every message is written as canonical JSON:
keys sorted, no spaces, UTF-8, numbers as Python's json writes them.

The result has a row for each message and an order key, so that a conversation
of any length is never gathered in one task.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import stored

_REF = re.compile(r"\$\{([^{}]+)\}")
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


_LONE = re.compile("[\ud800-\udfff]")


def escaped(text: str) -> str:
    """``text`` with lone surrogates, which UTF-8 cannot hold, written as JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    return escaped(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")))


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """What of ``value`` breaks ``schema``: type, required, properties, additionalProperties, items, enum, minimum, maximum."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds):
        return [f"{at}: not {'/'.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            found.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            found.append(f"{at}: above maximum")
    if isinstance(value, dict):
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        known = schema.get("properties", {})
        for k in sorted(value):
            if k in known:
                if not (isinstance(value[k], str) and _REF.fullmatch(value[k])):
                    found += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += violations(x, schema["items"], f"{at}[{i}]")
    return found


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(text)
    return value


def loads(text: str) -> object:
    """The value of a JSON text, or None; texts that nest too deeply, or hold NaN or numbers beyond a double, are no JSON."""
    try:
        return json.loads(text, parse_constant=_finite, parse_float=_finite)
    except (ValueError, RecursionError):
        return None


def calls_of(value: object) -> list[dict] | None:
    """The calls of an assistant's message: id, name, arguments (None if they are no JSON)."""
    listed = value.get("tool_calls") if isinstance(value, dict) else None
    if not isinstance(listed, list) or not all(isinstance(x, dict) for x in listed):
        return None
    found = []
    for x in listed:
        f = x.get("function") if isinstance(x.get("function"), dict) else x
        arguments = f.get("arguments", {})
        if isinstance(arguments, str):
            arguments = loads(arguments)
        found.append({"id": escaped(str(x.get("id", ""))), "name": escaped(str(f.get("name", ""))), "arguments": arguments})
    return found


def topological(calls: list[dict]) -> tuple[list[dict], bool]:
    """Calls after those they refer to, otherwise in their order; False with the order as it was if they refer in a circle."""
    places: dict[str, list[int]] = {}
    for i, c in enumerate(calls):
        places.setdefault(c["id"], []).append(i)
    needs = [{x for x in _REF.findall(canonical(c["arguments"])) if x in places} for c in calls]
    waiting: dict[str, list[int]] = {}
    for i, own in enumerate(needs):
        for x in own:
            waiting.setdefault(x, []).append(i)
    open_ids, missing = {x: len(at) for x, at in places.items()}, [len(own) for own in needs]
    ready = [i for i, n in enumerate(missing) if not n]
    out = []
    while ready:
        i = heapq.heappop(ready)
        out.append(calls[i])
        open_ids[calls[i]["id"]] -= 1
        if not open_ids[calls[i]["id"]]:
            for k in waiting.get(calls[i]["id"], ()):
                missing[k] -= 1
                if not missing[k]:
                    heapq.heappush(ready, k)
    return (out, True) if len(out) == len(calls) else (calls, False)


def parsed(role: str | None, text: str | None, schemas: dict) -> tuple[str, list[str], list[str], list[str], str | None]:
    """(canonical JSON, call ids, call names, errors, the id that a result answers) of a message."""
    message: dict = {"role": role, "content": text}
    value = loads(text) if text and text.lstrip()[:1] == "{" else None
    if role == "assistant" and (calls := calls_of(value)) is not None:
        calls, acyclic = topological(calls)
        errors = [] if acyclic else ["cycle"]
        for c in calls:
            if c["arguments"] is None:
                errors.append(f"{c['id']}: arguments are no JSON")
            elif c["name"] not in schemas:
                if schemas:
                    errors.append(f"{c['id']}: unknown tool")
            else:
                errors += [f"{c['id']}: {x}" for x in violations(c["arguments"], schemas[c["name"]])]
        message = {"role": role, "content": value.get("content"), "tool_calls": calls}
        return canonical(message), [c["id"] for c in calls], [c["name"] for c in calls], [escaped(x) for x in errors], None
    if role == "tool" and isinstance(value, dict) and "tool_call_id" in value:
        answered = escaped(str(value["tool_call_id"]))
        return canonical({"role": role, "content": value.get("content"), "tool_call_id": answered}), [], [], [], answered
    return canonical(message), [], [], [], None


def parse(messages: DataFrame, schemas: dict) -> DataFrame:
    kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
    names = ["body", "call_ids", "call_names", "errors", "answers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = zip(*[parsed(r, t, schemas) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(list(c), k) for c, k in zip(rows, kinds))], ["conv_id", "turn", "role", *names])

    slim = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "conv_id long, turn long, role string, body string, call_ids array<string>, call_names array<string>, errors array<string>, answers string")


def link(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """``(conv_id, turn, role, order_turn, order_pos, n_calls, n_answered, errors, status, message)``, a row per message.

    Ordered by conv_id, order_turn, order_pos, a result follows the message
    with its call, in the order of the calls; other messages keep their turn,
    with position 0. ``status`` is ``plain``, ``calls``, ``result``, or
    ``orphan`` for a result whose call is nowhere in the conversation. If an
    identifier is used twice, the first call (by turn, then position) owns it;
    every result with it links to that call. Null texts and roles are written
    as null; rows without a conversation have no links; repeated rows come out
    as often as they went in. Escapes of lone surrogates stay escapes.
    """
    said = stored(parse(messages, schemas or {}))
    calls = said.where(F.size("call_ids") > 0).select("conv_id", "turn", F.posexplode(F.arrays_zip("call_ids", "call_names")).alias("pos", "c")).select("conv_id", "turn", "pos", F.col("c.call_ids").alias("call_id"), F.col("c.call_names").alias("name"))
    owner = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "pos", "name")).alias("call"))
    results = said.where("answers is not null").groupBy("conv_id", F.col("answers").alias("call_id")).agg(F.count("*").alias("n"))
    answered = owner.join(results, ["conv_id", "call_id"]).groupBy("conv_id", F.col("call.turn").alias("turn")).agg(F.count("*").alias("n_answered"))
    out = said.join(owner.withColumnRenamed("call_id", "answers"), ["conv_id", "answers"], "left").join(answered, ["conv_id", "turn"], "left")
    is_result, has_calls = F.col("answers").isNotNull(), F.size("call_ids") > 0
    linked = F.col("call").isNotNull()
    named = F.concat(F.lit('{"call":'), F.to_json(F.struct(F.col("call.name").alias("name"), F.col("call.turn").alias("turn"))), F.lit(","), F.expr("substring(body, 2)"))
    return out.select(
        "conv_id", "turn", "role",
        F.when(linked, F.col("call.turn")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(linked, F.col("call.pos") + 1).otherwise(0).cast("long").alias("order_pos"),
        F.size("call_ids").cast("long").alias("n_calls"),
        F.when(has_calls, F.coalesce("n_answered", F.lit(0))).otherwise(0).cast("long").alias("n_answered"),
        F.array_join("errors", "; ").alias("errors"),
        F.when(has_calls, "calls").when(is_result & linked, "result").when(is_result, "orphan").otherwise("plain").alias("status"),
        F.when(linked, named).otherwise(F.col("body")).alias("message"),
    )
