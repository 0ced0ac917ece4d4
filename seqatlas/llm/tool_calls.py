"""Tool-call linking: calls joined with their results, ordered, validated and serialised.

Calls and results meet by a hash join on the call identifier. A call may name one parent, the
call whose result it needs; its level is the number of ancestors, found for all calls at once by
pointer doubling (the step to the ancestor doubles each round), so a chain of n calls takes
log2(n) rounds and no conversation is gathered in one task. (level, turn, call_id) is a
topological order of a conversation.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seqatlas.llm.common import stage

RESULT = "conv_id long, call_id string, name string, turn long, parent_id string, level long, result_turn long, n_results long, valid boolean, errors string, canonical string"
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
# The calls that conversations are read as.
SCHEMAS = {
    "ask": {"required": ["text", "turn"], "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "chars": {"type": "integer", "maximum": 4000}}},
    "configure": {"required": ["text", "turn"], "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0, "maximum": 0}, "chars": {"type": "integer", "maximum": 4000}}},
}


def canonical_json(value: object) -> str:
    """Sorted keys, no white space, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def violations(arguments: object, schema: dict | None) -> list[str]:
    """What is wrong with the arguments, in the order of the schema; no schema means an unknown tool."""
    if schema is None:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["arguments are not an object"]
    out = [f"{k} is missing" for k in schema.get("required", []) if k not in arguments]
    properties = schema.get("properties", {})
    for key, rule in properties.items():
        if key not in arguments:
            continue
        value, kind = arguments[key], rule.get("type")
        if kind and (not isinstance(value, TYPES[kind]) or kind in ("integer", "number") and isinstance(value, bool)):
            out.append(f"{key} is not of type {kind}")
            continue
        if "enum" in rule and value not in rule["enum"]:
            out.append(f"{key} is not one of the allowed values")
        if "minimum" in rule and value < rule["minimum"] or "minLength" in rule and len(value) < rule["minLength"]:
            out.append(f"{key} is too small")
        if "maximum" in rule and value > rule["maximum"] or "maxLength" in rule and len(value) > rule["maxLength"]:
            out.append(f"{key} is too large")
    if not schema.get("additionalProperties", True):
        out += [f"{k} is not allowed" for k in sorted(arguments) if k not in properties]
    return out


def _key(column: str, *spread: str) -> Column:
    """A join key for the left side of a left join: rows without an identifier match nothing and are spread by other columns.

    Null keys would all be sent to one task otherwise. The other side's keys start with ``k`` too.
    """
    return F.when(F.col(column).isNotNull(), F.concat(F.lit("k"), F.col(column))).otherwise(F.concat(F.lit("n"), F.xxhash64(*spread).cast("string")))


def _named(column: str) -> Column:
    return F.concat(F.lit("k"), F.col(column))


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of (call_id, parent_id) with distinct ids: the number of ancestors; null on or under a cycle.

    A parent that isn't a call ends the chain. After k rounds a pointer has gone 2**k steps, so
    one that hasn't ended once 2**k exceeds the number of calls is in a cycle.
    """
    ids = calls.select("call_id").where("call_id is not null")
    known = ids.select(F.col("call_id").alias("_p"), _named("call_id").alias("_pk"))
    state = calls.where("call_id is not null").withColumn("_k", _key("parent_id", "call_id")).join(known, F.col("_k") == F.col("_pk"), "left").select("call_id", F.col("_p").alias("up"), F.when(F.col("_p").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    state, total, reach = stage(state, "levels"), None, 1
    while True:
        unfinished = state.where("up is not null")
        total = state.count() if total is None else total
        if reach > total or unfinished.isEmpty():
            break
        above = state.select(F.col("call_id").alias("_c"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        # A pointer that has ended stays as it is; the others point at a call.
        further = unfinished.join(above, F.col("up") == F.col("_c")).select("call_id", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"))
        state = stage(state.where("up is null").unionByName(further), "levels")
        reach *= 2
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("steps")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS, others: DataFrame | None = None) -> DataFrame:
    """One row per call, per result without a call, and per further result of a call.

    ``calls``: conv_id, call_id, name, arguments (JSON text), parent_id, turn. ``results``:
    conv_id, call_id, turn, content. A call with several results takes the one of the smallest turn (then
    content) and counts them; each of the others has a row of its own, so no number of results of
    one call ever is one row. Errors, joined by ``; ``: schema violations, no result, result
    before the call, parent missing, cycle, repeated identifier, no identifier, no call, further result. Rows
    with a null identifier are kept and linked to nothing; repeated rows give repeated rows. ``others`` (conv_id, turn,
    arguments) are turns that neither call nor answer: they are returned with the error ``unknown role``.
    """
    none = F.lit(None)
    first = F.min(F.struct("turn", "content")).alias("_r")
    answers = results.where("call_id is not null").groupBy("call_id").agg(first, F.count("*").alias("n_results"), F.min("conv_id").alias("_conv"))
    distinct = calls.where("call_id is not null").groupBy("call_id").agg(F.min("parent_id").alias("parent_id"), F.count("*").alias("_repeats"))
    ranked = levels(distinct.select("call_id", "parent_id")).join(distinct.select("call_id", "_repeats"), "call_id")
    answers, ranked = answers.withColumn("_a", _named("call_id")).drop("call_id"), ranked.withColumn("_c", _named("call_id")).drop("call_id", "parent_id")
    there = distinct.select(_named("call_id").alias("_q"))
    keyed = calls.withColumn("_id", _key("call_id", *calls.columns)).withColumn("_up", _key("parent_id", *calls.columns))
    joined = keyed.join(answers, F.col("_id") == F.col("_a"), "left").join(ranked, F.col("_id") == F.col("_c"), "left").join(there, F.col("_up") == F.col("_q"), "left")
    linked = joined.select(
        "conv_id", "call_id", "name", "turn", "parent_id", "level", F.col("_r.turn").alias("result_turn"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        "arguments", F.col("_r.content").alias("content"), F.col("_repeats").alias("repeats"), F.col("_q").isNotNull().alias("has_parent"), none.cast("string").alias("problem"),
    )
    orphans = results.join(distinct.select("call_id"), "call_id", "left_anti").withColumn("_problem", F.lit("no call"))
    # Results after the first one: equal ones are counted, and one of those equal to the first is that itself.
    same = results.join(distinct.select("call_id"), "call_id", "left_semi").groupBy("conv_id", "call_id", "turn", "content").agg(F.count("*").alias("_n"))
    firsts = answers.select("_a", F.col("_r.turn").alias("_turn"), F.col("_r.content").alias("_content"), F.col("_conv").alias("_first"))
    kept = same.join(firsts, _named("call_id") == F.col("_a"))
    is_first = F.col("turn").eqNullSafe(F.col("_turn")) & F.col("content").eqNullSafe(F.col("_content")) & F.col("conv_id").eqNullSafe(F.col("_first"))
    more = kept.withColumn("_more", F.when(is_first, F.col("_n") - 1).otherwise(F.col("_n"))).where("_more > 0")
    more = more.select("conv_id", "call_id", "turn", "content", F.lit("further result").alias("_problem"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_more")))).drop("col")
    orphans = orphans.select("conv_id", "call_id", "turn", "content", "_problem").unionByName(more)
    orphans = orphans.select(
        "conv_id", "call_id", none.cast("string").alias("name"), none.cast("long").alias("turn"), none.cast("string").alias("parent_id"), none.cast("long").alias("level"),
        F.col("turn").alias("result_turn"), F.lit(1).cast("long").alias("n_results"), none.cast("string").alias("arguments"), "content", none.cast("long").alias("repeats"),
        F.lit(False).alias("has_parent"), F.col("_problem").alias("problem"),
    )

    def serialise(batches):
        for batch in batches:
            out = []
            for r in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                errors, arguments = [], None
                if r["problem"] is not None:
                    errors.append(r["problem"])
                    arguments = json.loads(r["arguments"]) if r["arguments"] is not None else None
                else:
                    try:
                        arguments = json.loads(r["arguments"]) if r["arguments"] is not None else None
                    except ValueError:
                        arguments = r["arguments"]
                    errors += violations(arguments, schemas.get(r["name"]))
                    if r["call_id"] is None:
                        errors.append("no identifier")
                    elif r["level"] is None:
                        errors.append("cycle")
                    if r["repeats"] is not None and r["repeats"] > 1:
                        errors.append("repeated identifier")
                    if r["parent_id"] is not None and not r["has_parent"]:
                        errors.append("parent missing")
                    if not r["n_results"]:
                        errors.append("no result")
                    elif r["turn"] is not None and r["result_turn"] is not None and r["result_turn"] <= r["turn"]:
                        errors.append("result before the call")
                whole = {"arguments": arguments, "id": r["call_id"], "name": r["name"], "parent": r["parent_id"], "result": r["content"]}
                out.append((r["conv_id"], r["call_id"], r["name"], r["turn"], r["parent_id"], r["level"], r["result_turn"], r["n_results"], not errors, "; ".join(errors), canonical_json(whole)))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield frame.astype({c: "Int64" for c in ("conv_id", "turn", "level", "result_turn", "n_results")})

    rows = linked.unionByName(orphans)
    if others is not None:
        rows = rows.unionByName(others.select(
            "conv_id", none.cast("string").alias("call_id"), none.cast("string").alias("name"), "turn", none.cast("string").alias("parent_id"), none.cast("long").alias("level"),
            none.cast("long").alias("result_turn"), F.lit(0).cast("long").alias("n_results"), "arguments", none.cast("string").alias("content"), none.cast("long").alias("repeats"),
            F.lit(False).alias("has_parent"), F.lit("unknown role").alias("problem"),
        ))
    return rows.mapInPandas(serialise, RESULT)


def _none(rows: DataFrame) -> Column:
    """The name of no call, different for most rows, so that turns without a number don't meet in one task."""
    return F.concat(F.lit("none_"), F.xxhash64(*rows.columns).cast("string"))


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other turns of chats: user and system turns call, the next turn of an assistant is the result.
    Turns with another role or none are the others.

    A call needs the call one turn before it, or else the one two turns before (whose result came between).
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    name_of = lambda conv, turn: F.concat(F.lit("call_"), conv.cast("string"), F.lit("_"), turn.cast("string"))
    called = rows.where("role in ('user', 'system')").withColumn("call_id", name_of(F.col("conv_id"), F.col("turn")))
    ids = called.where("call_id is not null").select("call_id").distinct()
    calls = called.withColumn("_one", F.coalesce(name_of(F.col("conv_id"), F.col("turn") - 1), _none(rows))).withColumn("_two", F.coalesce(name_of(F.col("conv_id"), F.col("turn") - 2), _none(rows)))
    calls = calls.join(ids.select(F.col("call_id").alias("_1")), F.col("_one") == F.col("_1"), "left").join(ids.select(F.col("call_id").alias("_2")), F.col("_two") == F.col("_2"), "left")
    arguments = F.to_json(F.struct("turn", "text", F.length("text").alias("chars")))
    calls = calls.select("conv_id", "call_id", F.when(F.col("role") == "user", "ask").otherwise("configure").alias("name"), arguments.alias("arguments"), F.coalesce("_1", "_2").alias("parent_id"), "turn")
    results = rows.where("role = 'assistant'").select("conv_id", name_of(F.col("conv_id"), F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    others = rows.where(~F.coalesce(F.col("role").isin("user", "system", "assistant"), F.lit(False)))
    # Null fields are written too.
    whole = F.to_json(F.struct(F.length("text").alias("chars"), "role", "text", "turn"), {"ignoreNullFields": "false"})
    return calls, results, others.select("conv_id", "turn", whole.alias("arguments"))


def link_conversations(conversations: DataFrame) -> DataFrame:
    """One row per turn that calls, per assistant turn without a call or after the first result, and per turn of another role."""
    calls, results, others = calls_of_conversations(conversations)
    return link(calls, results, others=others)
