"""Chat formatting with tool-call linking.

Turns whose text is a JSON object of exactly these keys carry tool traffic: in role ``assistant`` ``{"content"?,
"tool_calls": [{"id", "name", "arguments"?}, ...]}`` (arguments a value, or its JSON in a string), in
role ``tool`` ``{"tool_call_id", "content"?}``.  Every other text is content as it stands: of other roles, with other
keys, with keys twice, with NaN or infinite numbers, nested too deep, without calls.

Calls and results are hash-joined by (conv_id, identifier).  A call that names
other calls in its arguments as ``"${id}"`` comes after their results, a result right after its
call.  Its level is the length of its longest chain of needs: conversations of up to ``LINKS`` needs are ordered each in
a task; larger ones are cut in parts of ``LINKS`` calls by turn, and in each round over written tables every part orders
what it can from what is done, and a need of a call that has one need alone is replaced by that one, so that a
chain halves with each round and a conversation that needs what came before takes a round a part.  Only calls on a cycle, and those that
need one, are ``cyclic`` and keep their own turn.  Arguments are checked against the
tool's schema.  Every piece becomes one canonical JSON message: keys sorted, no
spaces, text unescaped (but lone surrogates).

Messages are rows, range-sorted by conversation and place, never collected: a
conversation may be longer than a task's memory.

Edge cases: a null role is ``""`` and a null text is content null; a conv_id that is no whole number stays a string; a
turn that is none is null; null conv_id or turn sort first and are kept, their
calls and results linked as in any conversation; of equal call identifiers, and of
several results for one call, the earliest links and the others are ``repeated``; a result without
call is an ``orphan`` and stays at its turn; repeated rows are messages of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut

#: Schemas of the tools that production conversations may call; unknown tools are not checked.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}}, "required": ["url"]},
}

_NEEDS = re.compile(r"\$\{([^{}]+)\}")
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
_SURROGATE = re.compile("[\ud800-\udfff]")
#: Needs of a conversation that one task orders; calls of a part of a larger one.
LINKS = 100_000


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _once(pairs: list[tuple]) -> dict:
    if len(found := dict(pairs)) < len(pairs):
        raise ValueError("a key twice")
    return found


def _not_json(name: str) -> None:
    raise ValueError(name)


def _parsed(text: str):
    return json.loads(text, object_pairs_hook=_once, parse_constant=_not_json)


def _named(value) -> bool:
    return isinstance(value, str) and not _SURROGATE.search(value)


def schema_fault(value, schema: dict, at: str = "$") -> str | None:
    """The first place where a value breaks a schema (type, enum, properties, required, additionalProperties, items)."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or isinstance(value, float) and (kind == "number" or value.is_integer())
        if isinstance(value, bool) or not whole:
            return f"{at}: not {kind}"
    elif kind and not isinstance(value, _TYPES[kind]):
        return f"{at}: not {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", ()):
            if k not in value:
                return f"{at}.{k}: missing"
        for k in sorted(value):
            if k in known:
                if fault := schema_fault(value[k], known[k], f"{at}.{k}"):
                    return fault
            elif schema.get("additionalProperties") is False:
                return f"{at}.{k}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if fault := schema_fault(x, schema["items"], f"{at}[{i}]"):
                return fault
    return None


def pieces_of(role: str, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(kind, call_id, name, body, fault, needs) of one turn: kind is message, call or result."""
    if text and role in ("assistant", "tool") and text.lstrip()[:1] == "{":
        try:
            if found := _traffic(role, _parsed(text), schemas):
                return found
        except (ValueError, RecursionError):
            pass
    return [("message", None, None, canonical(text), None, [])]


def _traffic(role: str, found: dict, schemas: dict[str, dict]) -> list[tuple]:
    if role == "tool":
        if not found.keys() <= {"tool_call_id", "content"} or not _named(found.get("tool_call_id")):
            return []
        return [("result", found["tool_call_id"], None, canonical(found.get("content")), None, [])]
    calls = found.get("tool_calls")
    if not found.keys() <= {"tool_calls", "content"} or not isinstance(calls, list):
        return []
    if not all(isinstance(c, dict) and c.keys() <= {"id", "name", "arguments"} and _named(c.get("id")) and _named(c.get("name")) for c in calls):
        return []
    out = []
    if calls and found.get("content") is not None:
        out.append(("message", None, None, canonical(found["content"]), None, []))
    for c in calls:
        args, fault = c.get("arguments"), None
        if isinstance(args, str):
            try:
                args = _parsed(args)
            except (ValueError, RecursionError):
                fault = "$: not JSON"
        if fault is None and c["name"] in schemas:
            fault = schema_fault(args, schemas[c["name"]])
        body = canonical(args)
        out.append(("call", c["id"], c["name"], body, fault and _SURROGATE.sub("?", fault), sorted(set(_NEEDS.findall(body)))))
    return out


def _pieces(turns: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                role = role or ""
                for seq, (kind, call_id, name, body, fault, needs) in enumerate(pieces_of(role, text, schemas)):
                    out.append({"conv_id": conv, "turn": turn, "seq": seq, "kind": kind, "role": role, "call_id": call_id, "name": name, "body": body, "fault": fault, "needs": needs})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    text, whole = pa.string(), isinstance(turns.schema["conv_id"].dataType, IntegralType)
    schema = pa.schema([("conv_id", pa.int64() if whole else text), ("turn", pa.int64()), ("seq", pa.int32()), *[(k, text) for k in ("kind", "role", "call_id", "name", "body", "fault")], ("needs", pa.list_(text))])
    ddl = f"conv_id {'long' if whole else 'string'}, turn long, seq int, kind string, role string, call_id string, name string, body string, fault string, needs array<string>"
    return turns.select(F.col("conv_id").cast("long" if whole else "string"), F.col("turn").try_cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(parse, ddl)


def _order(block: pa.Table) -> pa.Table:
    """Turn and level of the calls of one conversation that have needs, given as (conv, call_id, at, need, need_at)."""
    rows = block.to_pylist()
    at, level, needs, waiting = {}, {}, {}, {}
    for r in rows:
        at[r["call_id"]] = r["at"]
        needs.setdefault(r["call_id"], []).append(r["need"])
    for r in rows:
        if r["need"] not in needs:
            at[r["need"]], level[r["need"]] = r["need_at"], 0
        waiting.setdefault(r["need"], []).append(r["call_id"])
    open_ = {c: len(n) for c, n in needs.items()}
    ready, placed = list(level), []
    while ready:
        done = ready.pop()
        for c in waiting.get(done, ()):
            open_[c] -= 1
            if not open_[c]:
                level[c] = 1 + max(level[n] for n in needs[c])
                at[c] = max((at[x] for x in (c, *needs[c]) if at[x] is not None), default=None)
                placed.append(c)
                ready.append(c)
    calls = [*placed, *(c for c in needs if c not in level)]
    conv = block.column("conv")[0].as_py()
    return pa.table({"conv": pa.array([conv] * len(calls), pa.string()), "call_id": pa.array(calls, pa.string()), "at": pa.array([at[c] for c in calls], pa.int64()), "level": pa.array([level.get(c, 0) for c in calls], pa.int32()), "cyclic": pa.array([c not in level for c in calls], pa.bool_())})


def _order_part(block: pa.Table) -> pa.Table:
    """Turn and level of the calls of one part of a conversation whose needs are done or become so within it, given as
    (conv, call_id, at, need, steps, over, need_at, need_level): ``steps`` calls lie between a call and a need, ``over`` at most
    their turn."""
    at, needs, waiting, known = {}, {}, {}, {}
    for call, own, need, steps, over, need_at, level in zip(*(block.column(c).to_pylist() for c in ("call_id", "at", "need", "steps", "over", "need_at", "need_level")), strict=True):
        at[call] = own
        needs.setdefault(call, []).append((need, steps, over))
        waiting.setdefault(need, []).append(call)
        if level is not None:
            known[need] = level, need_at
    open_ = {c: sum(n not in known for n, _, _ in x) for c, x in needs.items()}
    ready, placed = [c for c, n in open_.items() if not n], []
    while ready:
        c = ready.pop()
        turns = [at[c], *(x for n, _, over in needs[c] for x in (over, known[n][1]))]
        known[c] = max(known[n][0] + steps for n, steps, _ in needs[c]), max((t for t in turns if t is not None), default=None)
        placed.append(c)
        for later in waiting.get(c, ()):
            open_[later] -= 1
            if not open_[later]:
                ready.append(later)
    conv = block.column("conv")[0].as_py()
    return pa.table({"conv": pa.array([conv] * len(placed), pa.string()), "call_id": pa.array(placed, pa.string()), "at": pa.array([known[c][1] for c in placed], pa.int64()), "level": pa.array([known[c][0] for c in placed], pa.int32())})


def _order_large(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """The same for conversations of any size, in rounds. ``calls``: conv, call_id, at; ``edges``: conv, call_id, need."""
    edges = cut(edges.select("conv", "call_id", "need", F.lit(1).alias("steps"), F.lit(None).cast("long").alias("over")))
    linked = edges.select("conv", "call_id").distinct()
    done = cut(calls.join(edges.select("conv", F.col("need").alias("call_id")).distinct(), ["conv", "call_id"], "left_semi").join(linked, ["conv", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("conv").orderBy("at", "call_id")) - 1
    left = cut(calls.join(linked, ["conv", "call_id"], "left_semi").withColumn("part", F.floor(place / LINKS)))
    # a chain is folded after so many rounds: what frees no call for longer is a cycle
    patience = idle = math.ceil(math.log2(edges.count() + 2)) + 1
    while idle and not left.isEmpty():
        met = edges.join(done.select("conv", F.col("call_id").alias("need"), F.col("at").alias("need_at"), F.col("level").alias("need_level")), ["conv", "need"], "left").join(left, ["conv", "call_id"])
        new = cut(met.groupBy("conv", "part").applyInArrow(_order_part, "conv string, call_id string, at long, level int"))
        idle = idle - 1 if new.isEmpty() else patience
        done, left = cut(done.unionByName(new)), cut(left.join(new, ["conv", "call_id"], "left_anti"))
        edges = edges.join(new, ["conv", "call_id"], "left_anti")
        single = edges.groupBy("conv", "call_id").agg(F.count("*").alias("n"), F.first("need").alias("next"), F.first("steps").alias("more"), F.first("over").alias("also")).filter("n = 1")
        single = single.join(left, ["conv", "call_id"]).select("conv", F.col("call_id").alias("need"), "next", "more", F.greatest("also", "at").alias("also"))
        edges = cut(edges.join(single, ["conv", "need"], "left").select("conv", "call_id", F.coalesce("next", "need").alias("need"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.greatest("over", "also").alias("over")))
    return done.join(linked, ["conv", "call_id"], "left_semi").withColumn("cyclic", F.lit(False)).unionByName(left.select("conv", "call_id", "at", F.lit(0).alias("level"), F.lit(True).alias("cyclic")))


def _levels(calls: DataFrame) -> DataFrame:
    """conv, call_id, at (turn it can run in), level (length of its chain of needs), cyclic."""
    calls = cut(calls.select("conv", "call_id", F.col("turn").alias("at"), "needs"))
    known = calls.select("conv", F.col("call_id").alias("need"), F.col("at").alias("need_at"))
    edges = cut(calls.select("conv", "call_id", "at", F.explode("needs").alias("need")).join(known, ["conv", "need"]))
    free = calls.join(edges.select("conv", "call_id").distinct(), ["conv", "call_id"], "left_anti").select("conv", "call_id", "at", F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
    large = cut(edges.groupBy("conv").agg(F.count("*").alias("n")).filter(F.col("n") > LINKS).select("conv"))
    ordered = edges.join(large, "conv", "left_anti").select("conv", "call_id", "at", "need", "need_at").groupBy("conv").applyInArrow(_order, "conv string, call_id string, at long, level int, cyclic boolean")
    if not large.isEmpty():
        ordered = ordered.unionByName(_order_large(calls.drop("needs").join(large, "conv", "left_semi"), edges.join(large, "conv", "left_semi")))
    return free.unionByName(ordered)


def format_chats(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, seq, kind, status, fault, at, level, message; sorted by conversation, then place.

    Place is (at, message before traffic, level, turn and seq of the call, call before result).
    status: plain, linked, unanswered, cyclic, orphan or repeated."""
    pieces = cut(_pieces(turns, SCHEMAS if schemas is None else schemas))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    plain = pieces.filter("kind = 'message'")
    traffic = cut(pieces.filter("kind <> 'message'").withColumn("conv", conv).withColumn("first", F.row_number().over(Window.partitionBy("conv", "call_id", "kind").orderBy("turn", "seq", "body")) == 1))
    calls, results = traffic.filter("kind = 'call' and first"), traffic.filter("kind = 'result' and first")
    leveled = _levels(calls)
    answered = results.select("conv", "call_id", F.lit(True).alias("answered"))
    placed_calls = calls.join(leveled, ["conv", "call_id"]).join(answered, ["conv", "call_id"], "left")
    status = F.when(F.col("cyclic"), "cyclic").when(F.col("answered"), "linked").otherwise("unanswered")
    order = lambda turn, seq, later: F.struct(F.lit(1).alias("traffic"), F.col("level"), turn.alias("turn"), seq.alias("seq"), F.lit(later).alias("later"))
    columns = ["conv_id", "turn", "seq", "kind", "role", "call_id", "name", "body", "fault"]
    call_rows = placed_calls.select(*columns, status.alias("status"), "at", "level", order(F.col("turn"), F.col("seq"), 0).alias("place"))
    owner = placed_calls.select("conv", "call_id", F.col("name").alias("call_name"), F.col("turn").alias("call_turn"), F.col("seq").alias("call_seq"), F.col("at").alias("call_at"), F.col("level").alias("call_level"))
    joined = results.join(owner, ["conv", "call_id"], "left").withColumn("name", F.col("call_name")).withColumn("level", F.coalesce("call_level", F.lit(0)))
    result_rows = joined.select(*columns, F.when(F.col("call_name").isNull(), "orphan").otherwise("linked").alias("status"), F.coalesce("call_at", "turn").alias("at"), "level", order(F.coalesce("call_turn", "turn"), F.coalesce("call_seq", "seq"), 1).alias("place"))
    loose = traffic.filter("not first").withColumn("level", F.lit(0)).select(*columns, F.lit("repeated").alias("status"), F.col("turn").alias("at"), "level", order(F.col("turn"), F.col("seq"), 2).alias("place"))
    text_rows = plain.withColumn("level", F.lit(0)).select(*columns, F.lit("plain").alias("status"), F.col("turn").alias("at"), "level", F.struct(F.lit(0).alias("traffic"), F.col("level"), F.col("turn"), F.col("seq"), F.lit(0).alias("later")).alias("place"))
    rows = text_rows.unionByName(call_rows).unionByName(result_rows).unionByName(loose)
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 2**30)  # noqa: E731  '"text"]'
    text = lambda c: F.expr(f"substring({c}, 1, length({c}) - 1)")
    rows = rows.withColumn("_role", quoted(F.col("role"))).withColumn("_id", quoted(F.col("call_id"))).withColumn("_name", quoted(F.coalesce("name", F.lit(""))))
    message = (
        F.when(F.col("kind") == "message", F.concat(F.lit('{"content":'), "body", F.lit(',"role":'), text("_role"), F.lit("}")))
        .when(F.col("kind") == "call", F.concat(F.lit('{"role":'), text("_role"), F.lit(',"tool_call":{"arguments":'), "body", F.lit(',"id":'), text("_id"), F.lit(',"name":'), text("_name"), F.lit("}}")))
        .otherwise(F.concat(F.lit('{"content":'), "body", F.lit(',"name":'), text("_name"), F.lit(',"role":'), text("_role"), F.lit(',"tool_call_id":'), text("_id"), F.lit("}")))
    )
    out = rows.withColumn("message", message)
    return out.repartitionByRange("conv_id", "at", "place").sortWithinPartitions("conv_id", "at", "place").select("conv_id", "turn", "seq", "kind", "status", "fault", "at", "level", "message")
