"""Chat formatting: tool-call linking. Native: DataFrame functions only.

Messages are rows (conv_id, turn, tool_calls, tool_call_id, parent_ids, text). ``tool_calls``
are structs (id, name, arguments: JSON text); a message with ``tool_call_id`` carries the
result of the call with that id in its conversation; ``parent_ids`` names the calls of the same
conversation that the message's calls build on.

* Linking is a hash join of calls and results by (conv_id, id). Of calls that share an id the
  first (by turn, then place) is the one that results belong to.
* Order: a call's level is the length of the longest chain of calls that it builds on. Calls with
  one parent find the nearest call above them that has several, or the start of their chain, by
  pointer doubling, in as many rounds as the logarithm of the longest chain; what is left, the calls
  with several parents, is peeled from the top, in as many rounds as such calls are nested. Calls on
  a cycle, or behind one, have no level and come last. (level, turn, place) then sorts calls after
  what they build on (:func:`in_order`), and a result goes with its call, whatever turn it arrived
  in. No conversation is gathered in one task.
* Arguments are checked against the tool's schema (the part of JSON Schema that :data:`KEYWORDS`
  names, nested as deep as it likes), compiled into one expression; a schema with any other keyword is
  refused.
* A call and its result are written as canonical JSON: keys sorted, no white space.

Defined results: null or empty ``tool_calls`` make no call; a call without an id is never
answered; a result whose id no call has is an orphan row; repeated calls and results are
answered each; arguments that are not a JSON object, or a tool without a schema, are invalid;
parents that are null, repeated or no call of the conversation count for nothing; of calls that share
an id the first one's parents count; an empty table gives an empty table; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: The tools of the query over ``conversations``.
TOOLS = {
    "ask": {
        "type": "object",
        "required": ["text", "turn"],
        "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0, "maximum": 4}},
        "additionalProperties": False,
    },
    "instruct": {
        "type": "object",
        "required": ["text"],
        "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 200}, "turn": {"type": "integer"}},
        "additionalProperties": False,
    },
}
#: JSON Schema types as the types that a variant's schema starts with.
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",), "null": ("VOID",)}


#: What a schema may say; the second line says nothing about what is valid.
KEYWORDS = {"type", "enum", "required", "properties", "additionalProperties", "items", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems"}
NOTES = {"title", "description", "default", "examples", "$schema"}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def is_type(value: Column, name: str) -> Column:
    """Whether a variant has a JSON type; 1.0 is an integer too."""
    kind = F.schema_of_variant(value)
    if name == "integer":
        n = F.try_variant_get(value, "$", "double")
        return F.coalesce(is_type(value, "number") & (n == F.floor(n)), F.lit(False))
    return reduce(lambda x, y: x | y, [kind.startswith(t) for t in _TYPES[name]])


def equals(value: Column, want) -> Column:
    """Whether a variant is a JSON value: numbers by value, others by their canonical text."""
    if isinstance(want, (int, float)) and not isinstance(want, bool):
        return is_type(value, "number") & (F.try_variant_get(value, "$", "double") == float(want))
    return ~is_type(value, "number") & (F.to_json(value) == canonical(want))


def rules(value: Column, schema: dict, path: str) -> list[tuple[Column, str]]:
    """(broken, what to say) for each rule of a schema on a variant that is there, in order."""
    if unknown := set(schema) - KEYWORDS - NOTES:
        raise ValueError(f"keywords that are not supported: {sorted(unknown)}")
    said = (lambda what: f"{path}: {what}") if path else (lambda what: what)
    out: list[tuple[Column, str]] = []
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        if any(k not in _TYPES for k in kinds):
            raise ValueError(f"types that are not known: {kinds}")
        out.append((~reduce(lambda x, y: x | y, [is_type(value, k) for k in kinds]), said("type") if path else "not an object"))
    if "enum" in schema:
        out.append((~reduce(lambda x, y: x | y, [F.coalesce(equals(value, w), F.lit(False)) for w in schema["enum"]], F.lit(False)), said("enum")))
    own = F.when(is_type(value, "object"), F.from_json(F.to_json(value), "map<string,variant>"))
    names = F.map_keys(own)
    for name in schema.get("required", []):
        out.append((~F.array_contains(names, name), f"{path}.{name}: missing" if path else f"{name}: missing"))
    if schema.get("additionalProperties") is False:
        known = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
        out.append((F.size(F.array_except(names, known)) > 0, said("unknown property")))
    elif not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError("additionalProperties must be true or false")
    for name, want in schema.get("properties", {}).items():
        # a property that is not there breaks no rule of its own
        child = F.try_element_at(own, F.lit(name))
        out += [(child.isNotNull() & F.coalesce(bad, F.lit(False)), what) for bad, what in rules(child, want, f"{path}.{name}" if path else name)]
    text, number = (F.when(is_type(value, k), F.try_variant_get(value, "$", t)) for k, t in (("string", "string"), ("number", "double")))
    items = F.when(is_type(value, "array"), F.from_json(F.to_json(value), "array<variant>"))
    bounds = {"minimum": lambda x: number < x, "maximum": lambda x: number > x, "minLength": lambda x: F.char_length(text) < x, "maxLength": lambda x: F.char_length(text) > x,
              "minItems": lambda x: F.size(items) < x, "maxItems": lambda x: F.size(items) > x}
    out += [(bad(schema[key]), said(key)) for key, bad in bounds.items() if key in schema]
    if "items" in schema:
        def some(what: str) -> Column:
            own = lambda x: [F.coalesce(bad, F.lit(False)) for bad, said in rules(x, schema["items"], f"{path}[]") if said == what]
            return F.exists(items, lambda x: reduce(lambda a, b: a | b, own(x)))

        out += [(some(what), what) for what in dict.fromkeys(what for _, what in rules(F.lit(None), schema["items"], f"{path}[]"))]
    return out


def problem(args: Column, schema: dict) -> Column:
    """The first rule of a schema that a variant breaks, or null."""
    out = F.lit(None).cast("string")
    for bad, said in reversed(rules(args, {"type": "object"} | schema, "")):
        out = F.when(F.coalesce(bad, F.lit(False)), said).otherwise(out)
    return F.when(args.isNull(), "not an object").otherwise(out)


def calls_of(messages: DataFrame) -> DataFrame:
    return messages.select("conv_id", "turn", "parent_ids", F.posexplode("tool_calls").alias("place", "__call")).select(
        "conv_id", "turn", "parent_ids", "place", F.col("__call.id").alias("call_id"), F.col("__call.name").alias("name"), F.col("__call.arguments").alias("arguments"))


def looked_up(rows: DataFrame, at: str, found: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` with what ``found`` (conv_id, call_id, ...) says of the call whose id stands in ``at``."""
    found = found.withColumnsRenamed({"conv_id": "__c", "call_id": "__i"})
    out = rows.join(found, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col(at) == F.col("__i")), how)
    return out.drop("__c", "__i")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id) to level: pointer doubling along single parents, then peeling."""
    ids = calls.where(F.col("call_id").isNotNull())
    first = ids.groupBy("conv_id", "call_id").agg(F.min_by("parent_ids", F.struct("turn", "place")).alias("ups"))
    first = materialize(first, "parents")
    edges = first.select("conv_id", "call_id", F.explode(F.array_distinct("ups")).alias("up"))
    edges = materialize(looked_up(edges, "up", first.select("conv_id", "call_id"), "left_semi"), "edges")
    n = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("__n"), F.min("up").alias("up"))
    own = n.select(F.col("conv_id").alias("__c"), F.col("call_id").alias("__i"), "__n", "up")
    state = first.drop("ups").join(own, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("call_id") == F.col("__i")), "left")
    # level counts the steps to ``up``, or, where that is null, to ``anchor``, or, where that is null too, to the start
    one = F.col("__n") == 1
    state = state.select(
        "conv_id", "call_id", F.when(one, F.col("up")).alias("up"), F.when(F.col("__n") > 1, F.col("call_id")).alias("anchor"), F.when(one, 1).otherwise(0).cast("long").alias("level"))
    state = materialize(state, "levels")
    most = state.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # no chain is longer
    done, open_, reach = state.where("up is null"), state.where("up is not null"), 1
    # only what is still open goes round; what is done is looked up
    while reach <= most and not open_.isEmpty():
        ahead = done.unionByName(open_).withColumnsRenamed({"up": "__up", "anchor": "__anchor", "level": "__level"})
        state = looked_up(open_, "up", ahead)
        state = materialize(state.select("conv_id", "call_id", F.col("__up").alias("up"), F.col("__anchor").alias("anchor"), (F.col("level") + F.coalesce("__level", F.lit(0))).alias("level")), "levels")
        done, open_, reach = done.unionByName(state.where("up is null")), state.where("up is not null"), 2 * reach
    cycles = open_.select("conv_id", "call_id", F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("long").alias("level"))
    near = done.drop("up").unionByName(cycles)
    if near.where("anchor is not null").isEmpty():
        return near.drop("anchor")
    peeled = peel(edges, near).withColumnRenamed("level", "__level")
    level = F.when(F.col("anchor").isNull(), F.col("level")).otherwise(F.col("level") + F.col("__level"))
    return looked_up(near, "anchor", peeled).select("conv_id", "call_id", level.alias("level"))


def peel(edges: DataFrame, near: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls with several parents that are behind no cycle.

    A row of ``waits`` is such a call, an anchor that it waits for (null: none) and the steps between;
    a parent on a cycle or behind one leaves null steps, which are never made up for.
    """
    joins = near.where(F.col("anchor") == F.col("call_id")).select("conv_id", "call_id")
    ups = edges.join(joins.withColumnsRenamed({"conv_id": "__c", "call_id": "__i"}), F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("call_id") == F.col("__i")), "left_semi")
    waits = looked_up(ups, "up", near).select("conv_id", "call_id", "anchor", (F.col("level") + 1).alias("steps"))
    waits = materialize(waits.groupBy("conv_id", "call_id", "anchor").agg(F.max("steps").alias("steps"), F.count_if(F.col("steps").isNull()).alias("lost")), "waits")
    solved, rounds = waits.select("conv_id", "call_id", F.col("steps").alias("level")).where("false"), 0
    while True:
        ready = waits.groupBy("conv_id", "call_id").agg(F.max("steps").alias("level"), (F.count("anchor") + F.sum("lost")).alias("__open")).where("__open = 0").drop("__open")
        ready = materialize(ready, "ready")
        if ready.isEmpty():
            return solved
        solved, rounds = solved.unionByName(ready), rounds + 1
        if rounds % 16 == 0:
            solved = materialize(solved, "solved")
        left = waits.join(ready.withColumnsRenamed({"conv_id": "__c", "call_id": "__i"}), F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("call_id") == F.col("__i")), "left_anti")
        left = looked_up(left, "anchor", ready)
        anchor = F.when(F.col("level").isNull(), F.col("anchor"))
        left = left.select("conv_id", "call_id", anchor.alias("anchor"), (F.col("steps") + F.coalesce("level", F.lit(0))).alias("steps"), "lost")
        before = waits
        waits = materialize(left.groupBy("conv_id", "call_id", "anchor").agg(F.max("steps").alias("steps"), F.sum("lost").alias("lost")), "waits")
        discard(before)


def link_tool_calls(messages: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """A row per call and result (a call without result once; an orphan result once):
    conv_id, level, turn, place, call_id, name, result_turn, status, problem, canonical."""
    calls = calls_of(messages)
    level = levels(calls)
    by_id = calls.withColumn("__call", F.struct("turn", "place"))
    owner = calls.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place")).alias("__owner"))
    owner = materialize(owner.join(level.withColumnsRenamed({"conv_id": "__c", "call_id": "__i"}), F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("call_id") == F.col("__i"))).select(
        F.col("conv_id").alias("__oc"), F.col("call_id").alias("__oi"), "__owner", "level"), "owners")
    here = by_id.join(owner, F.col("conv_id").eqNullSafe(F.col("__oc")) & (F.col("call_id") == F.col("__oi")), "left").drop("__oc", "__oi")
    here = here.withColumn("__id", F.when(F.col("__call").eqNullSafe(F.col("__owner")), F.col("call_id")))
    results = messages.where(F.col("tool_call_id").isNotNull()).select(
        F.col("conv_id").alias("__c"), F.col("tool_call_id").alias("__rid"), F.col("turn").alias("result_turn"), F.col("text").alias("__text"))
    both = here.join(results, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__id") == F.col("__rid")), "full_outer")
    args = F.try_parse_json("arguments")
    found = F.lit("unknown tool")
    for name, schema in sorted(tools.items()):
        found = F.when(F.col("name") == name, problem(F.col("__args"), schema)).otherwise(found)
    orphan = F.col("turn").isNull() & F.col("place").isNull()
    # the JSON text of a string: {"x":"..."} without its frame
    quoted = lambda c: F.regexp_replace(F.substring(F.to_json(F.struct(c.alias("x"))), 6, 2**31 - 1), r"\}\z", "")
    part = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit(f'"{key}":'), quoted(c)))
    body = F.concat_ws(
        ",",
        F.when(~orphan, F.concat(F.lit('"arguments":'), F.coalesce(F.to_json("__args"), F.when(F.col("arguments").isNotNull(), quoted(F.col("arguments"))), F.lit("null")))),
        part("id", F.coalesce("call_id", "__rid")), part("name", F.col("name")), part("result", F.col("__text")),
    )
    status = F.when(orphan, "orphan").when(F.col("result_turn").isNull() & F.col("__rid").isNull(), "unanswered").when(F.col("result_turn") < F.col("turn"), "early").otherwise("answered")
    return both.withColumn("__args", args).select(
        F.coalesce("conv_id", "__c").alias("conv_id"), "level", "turn", F.col("place").cast("int").alias("place"), F.coalesce("call_id", "__rid").alias("call_id"), "name", "result_turn",
        status.alias("status"), F.when(~orphan, found).alias("problem"), F.concat(F.lit("{"), body, F.lit("}")).alias("canonical"),
    )


def in_order(linked: DataFrame) -> DataFrame:
    """The rows of :func:`link_tool_calls`, each after what it builds on; calls without a level and
    orphans come last. A sort by ranges: a long conversation goes to several tasks."""
    return linked.orderBy("conv_id", *(F.asc_nulls_last(c) for c in ("level", "turn", "place", "result_turn", "canonical")))


def as_calls(conversations: DataFrame) -> DataFrame:
    """``conversations`` as tool messages: a user's or the system's turn is a call, known by
    its conversation and turn; any other turn (an assistant's, a tool's, one without a role) is the
    result of the turn before; a call builds on the call two turns before, or on the turn before where
    that is the system's."""
    ident = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    call = F.coalesce(F.col("role").isin("user", "system"), F.lit(False))
    args = F.to_json(F.struct(F.col("turn"), F.col("text")))
    name = F.when(F.col("role") == "user", "ask").otherwise("instruct")
    one = F.struct(ident(0).alias("id"), name.alias("name"), args.alias("arguments"))
    return conversations.select(
        "conv_id", "turn", "text",
        F.when(call, F.array(one)).alias("tool_calls"),
        F.when(~call, ident(1)).alias("tool_call_id"),
        F.when(call, F.array(F.when(F.col("turn") == 1, ident(1)).otherwise(ident(2)))).alias("parent_ids"),
    )


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = as_calls(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return link_tool_calls(messages, TOOLS)


OP4_SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, text, conv_id || ':' || turn AS id, CASE role WHEN 'user' THEN 'ask' ELSE 'instruct' END AS name,
         conv_id || ':' || CASE WHEN turn = 1 THEN 0 ELSE turn - 2 END AS up
  FROM conversations WHERE role IN ('user', 'system')
), r AS (SELECT conv_id, turn AS result_turn, text AS result, conv_id || ':' || (turn - 1) AS id FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'system')),
lev AS (
  SELECT id, 0 AS level FROM c WHERE up NOT IN (SELECT id FROM c)
  UNION ALL SELECT c.id, level + 1 FROM lev JOIN c ON c.up = lev.id
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, CAST(lev.level AS BIGINT) AS level, c.turn, CASE WHEN c.id IS NOT NULL THEN 0 END AS place,
       coalesce(c.id, r.id) AS call_id, c.name, r.result_turn,
       CASE WHEN c.id IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
       CASE WHEN c.id IS NULL THEN NULL WHEN c.text IS NULL THEN 'text: missing' WHEN length(c.text) < 1 THEN 'text: minLength'
            WHEN length(c.text) > CASE c.name WHEN 'ask' THEN 400 ELSE 200 END THEN 'text: maxLength'
            WHEN c.name = 'ask' AND c.turn > 4 THEN 'turn: maximum' END AS problem,
       '{' || concat_ws(',', CASE WHEN c.id IS NOT NULL THEN '"arguments":{' || coalesce('"text":' || to_json(c.text)::VARCHAR || ',', '') || '"turn":' || c.turn || '}' END,
         '"id":' || to_json(coalesce(c.id, r.id))::VARCHAR, '"name":"' || c.name || '"', '"result":' || to_json(r.result)::VARCHAR) || '}' AS canonical
FROM c FULL JOIN r ON c.id = r.id LEFT JOIN lev ON lev.id = c.id
"""
