"""Chat formatting: tool calls linked with their results, ordered, validated, as canonical JSON.

Calls and results are hash-joined by (conversation, call id). A call may name
calls that it depends on; its level is one more than its deepest dependency's, so
that order by (level, call id) is a topological order of each conversation. Levels
come from pointer doubling: no conversation is gathered in one task, and long
chains take few joins. Arguments are checked against the tool's schema, and every call becomes one
line of canonical JSON: sorted keys, no spaces, characters unescaped.

Status, the first that holds: `no_id` (a call or result without conversation or call
id), `duplicate` and `duplicate_result` (another row has this id), `cycle` (it
depends on itself, directly or through others, or on a call that does),
`unknown_tool`, `invalid_arguments`, `no_result`, `ok`; results without a call come as
`orphan_result`. No row is left out.

Defined results: dependencies on unknown ids count as met and are listed as
errors. Of different rows with one id the least by value is linked; equal rows count
once. Arguments are invalid where they are null, no JSON object, nested too deeply,
name a key twice, or hold what UTF-8 JSON cannot (NaN, infinities, lone surrogates);
such arguments are kept in the line as the text they were. Null content of a result
is kept as null. Very long arguments and contents are taken whole. Empty tables give
no rows. Columns not named here are left out, whatever their names.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.scratch import forget, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["conv_id", "call_id"]

# Tools and the types of their arguments; a name with ? may be left out.
SCHEMAS = {
    "search": {"query": "string", "limit": "integer", "strict?": "boolean"},
    "lookup": {"query": "string", "limit": "integer"},
    "compute": {"query": "string", "weights?": "array", "limit": "number"},
}

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def argument_errors(arguments: object, schema: dict[str, str]) -> list[str]:
    """What is wrong with a call's arguments, sorted."""
    if not isinstance(arguments, dict):
        return ["arguments are not an object"]
    fields = {name.rstrip("?"): (kind, name.endswith("?")) for name, kind in schema.items()}
    errors = [f"unknown: {name}" for name in arguments if name not in fields]
    for name, (kind, optional) in fields.items():
        if name not in arguments:
            errors += [] if optional else [f"missing: {name}"]
        elif not isinstance(arguments[name], TYPES[kind]) or (isinstance(arguments[name], bool) and kind != "boolean"):
            errors.append(f"not {kind}: {name}")
    return sorted(errors)


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def unrepeated(pairs: list[tuple[str, object]]) -> dict[str, object]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key is named twice")
    return found


def parsed(arguments: str | None) -> object:
    """The value of a JSON text that canonical JSON can hold; None otherwise."""
    try:
        value = json.loads(arguments or "", object_pairs_hook=unrepeated)
        canonical(value).encode()
    except (ValueError, RecursionError):
        return None
    return value


def depths(parents: DataFrame, most: int) -> DataFrame:
    """(conv_id, call_id, level): steps from each call to a call without a parent; null on and behind cycles.

    parents has one row for each call, with `up` (a call id or null). Pointers are
    doubled, so chains of ``most`` calls take log2 of that many joins; calls that have
    reached the end of their chain take part no more.
    """
    state = materialize(parents.select(*KEY, "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("level")), "depths")
    for _ in range(most.bit_length() + 1):
        going = state.filter("up IS NOT NULL")
        if going.limit(1).count() == 0:
            break
        ahead = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        moved = going.join(ahead, ["conv_id", "up"], "left").select(*KEY, F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        after = materialize(state.filter("up IS NULL").unionByName(moved), "depths")
        forget(state)
        state = after
    return state.select(*KEY, F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that no cycle holds back; calls has ids and `depends` (array of call ids).

    A call's level is one more than that of its deepest dependency. Every call
    follows one dependency at first; depths along these are found by pointer
    doubling, calls with a deeper dependency change over to it, and so on until
    none does. One dependency each needs one such round, however long the chain;
    conversations in which no call changes over are done.
    """
    nodes = calls.select(*KEY)
    edges = calls.select(*KEY, F.explode(F.array_distinct("depends")).alias("on"))
    edges = materialize(edges.join(nodes.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi").select(*KEY, "on"), "depends")
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    parents = nodes.join(edges.groupBy(*KEY).agg(F.max("on").alias("up")), KEY, "left")
    several = edges.groupBy(*KEY).count().filter("count > 1").limit(1).count() > 0
    done: list[DataFrame] = []
    while True:
        found = depths(parents, most)
        if not several:
            break
        # no level is the deepest of all: what depends on a cycle follows it
        none = F.lit(1 << 30)
        deep = found.select("conv_id", F.col("call_id").alias("on"), F.coalesce("level", none).alias("below"))
        best = edges.join(deep, ["conv_id", "on"]).groupBy(*KEY).agg(F.max_by(F.struct("on", "below"), F.struct(F.col("below"), F.col("on"))).alias("b"))
        deeper = F.col("b.below") + 1 > F.coalesce("level", none) + F.when(F.col("level").isNull(), 1).otherwise(0)
        moved = materialize(found.join(best, KEY, "left").select(*KEY, F.col("b.on").alias("up"), deeper.alias("deeper")), "parents")
        changed = moved.filter("deeper").select("conv_id").distinct()
        if changed.limit(1).count() == 0:
            break
        done.append(found.join(changed, "conv_id", "left_anti"))
        parents = moved.join(changed, "conv_id", "left_semi").select(*KEY, "up")
        edges = materialize(edges.join(changed, "conv_id", "left_semi"), "depends")
    for part in done:
        found = found.unionByName(part)
    return found.filter("level IS NOT NULL")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, str]] = SCHEMAS) -> DataFrame:
    """conv_id, call_id, tool, level, status, errors and line (canonical JSON) of every call, and of every result that is no call's.

    calls: conv_id, call_id, tool, arguments (JSON), depends (array of call ids);
    results: conv_id, call_id, content.
    """
    both = " AND ".join(f"{k} IS NOT NULL" for k in KEY)
    none = F.array().cast("array<string>")
    shape = {"tool": F.lit(None).cast("string"), "arguments": F.lit(None).cast("string"), "level": F.lit(None).cast("int"), "has_result": F.lit(False), "content": F.lit(None).cast("string"), "depends": none, "lost": none}
    row = lambda df, status, **given: df.select(*KEY, *((given | {k: v for k, v in shape.items() if k not in given})[k].alias(k) for k in shape), status.alias("status"))
    of_call = {k: F.col(k) for k in ("tool", "arguments", "depends")}
    of_result = {"content": F.col("content"), "has_result": F.lit(True)}

    calls = calls.select(*KEY, "tool", "arguments", F.array_sort(F.coalesce("depends", none)).alias("depends"))
    distinct = materialize(calls.filter(both).distinct(), "calls")
    one = distinct.groupBy(*KEY).agg(F.min(F.struct("tool", "arguments", "depends")).alias("c")).select(*KEY, "c.*")
    one = materialize(one, "calls")
    contents = results.filter(both).select(*KEY, "content").distinct()
    answers = materialize(contents.groupBy(*KEY).agg(F.min(F.struct(F.col("content").isNull().alias("none"), "content")).alias("r")).select(*KEY, F.col("r.content").alias("content")), "answers")

    known = one.select("conv_id", F.col("call_id").alias("on"))
    wanted = one.select(*KEY, F.explode("depends").alias("on")).join(known, ["conv_id", "on"], "left_anti")
    lost = wanted.groupBy(*KEY).agg(F.sort_array(F.collect_set("on")).alias("lost"))
    linked = one.join(answers.withColumn("has_result", F.lit(True)).hint("shuffle_hash"), KEY, "left").join(levels(one), KEY, "left").join(lost, KEY, "left")
    out = row(linked, F.when(F.col("level").isNull(), "cycle"), **of_call, level=F.col("level"), has_result=F.coalesce("has_result", F.lit(False)), content=F.col("content"), lost=F.coalesce("lost", none))
    out = out.unionByName(row(calls.filter(f"NOT ({both})"), F.lit("no_id"), **of_call))
    out = out.unionByName(row(distinct.exceptAll(one), F.lit("duplicate"), **of_call))
    out = out.unionByName(row(results.filter(f"NOT ({both})"), F.lit("no_id"), **of_result))
    out = out.unionByName(row(contents.exceptAll(answers), F.lit("duplicate_result"), **of_result))
    return serialise(out.unionByName(row(answers.join(one, KEY, "left_anti"), F.lit("orphan_result"), **of_result)), schemas)


def serialise(rows: DataFrame, schemas: dict[str, dict[str, str]]) -> DataFrame:
    types = dict(rows.dtypes)
    names = [*KEY, "tool", "level", "status", "errors", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            status, errors, lines = [], [], []
            for r in b.to_pylist():
                arguments = parsed(r["arguments"])
                tool = r["tool"]
                wrong = [f"unknown call: {x}" for x in r["lost"]]
                state = r["status"]
                if state is None or state == "cycle":
                    bad = argument_errors(arguments, schemas[tool]) if tool in schemas else ["unknown tool"]
                    state = state or ("unknown_tool" if tool not in schemas else "invalid_arguments" if bad else "ok" if r["has_result"] else "no_result")
                    wrong += bad
                status.append(state)
                errors.append(wrong)
                lines.append(canonical({"arguments": arguments if arguments is not None else r["arguments"], "depends": r["depends"], "id": r["call_id"], "level": r["level"], "result": r["content"], "status": state, "tool": tool}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(status, pa.string()), pa.array(errors, pa.list_(pa.string())), pa.array(lines, pa.string())], names)

    return rows.mapInArrow(run, f"conv_id {types['conv_id']}, call_id string, tool string, level int, status string, errors array<string>, line string")


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: every user turn calls a tool, the assistant turn after it is the result.

    A call depends on the calls two and four turns before it; the tool follows from
    a checksum of the text, and the arguments hold the whole text and its length.
    Turns of other roles are neither.
    """
    call_id = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    asked = conversations.filter("role = 'user'")
    tool = F.element_at(F.array(*[F.lit(t) for t in SCHEMAS]), (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % len(SCHEMAS) + 1).cast("int"))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), F.length("text").alias("limit")))
    depends = F.array_compact(F.array(*[F.when(F.col("turn") >= k, call_id(F.col("turn") - k)) for k in (2, 4)]))
    calls = asked.select("conv_id", call_id(F.col("turn")).alias("call_id"), tool.alias("tool"), arguments.alias("arguments"), depends.alias("depends"))
    answers = conversations.filter("role = 'assistant'")
    return calls, answers.select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
