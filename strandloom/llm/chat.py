"""Chat formatting with linked tool calls, in DataFrame expressions only.

Assistant messages may hold calls, tool messages results. Results meet their calls in a hash
join on conversation and identifier; a topological order of calls, results and calls that refer to
results is given as sort keys, so that no conversation is gathered into one row; arguments are
validated against tool schemas; and each message becomes canonical JSON (sorted keys, no white
space).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_CALL = r"(?s)<tool_call>(.*?)</tool_call>"
_RESULT = r"(?s)<tool_result id=\"([^\"]*)\">(.*?)</tool_result>"
_REFERENCE = r"\"\$result:([^\"]+)\""
#: Where a message without a turn stands.
_NO_TURN = (1 << 63) - 1
_CALL_TYPE = "array<struct<id:string,name:string,arguments:string>>"
#: JSON schema type -> types of a variant value, as Spark names them.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}


def parse_messages(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) with calls, call_id and content read from the text, a row for each result.

    An assistant's calls are <tool_call>{"id", "name", "arguments"}</tool_call>; a tool's results
    are <tool_result id="...">...</tool_result>. What is not JSON, or has no id, stays content.
    A tool message becomes a row for each of its results, numbered by `part` from 0 in their
    order; text around them, if any but white space, is a last row without call_id. Other
    messages are one row of part 0. A null text has no content; rows that repeat stay apart; other columns are
    dropped, whatever their names; an empty table stays empty; texts may be of any length.
    """
    def call(raw: Column) -> Column:
        v = F.try_parse_json(raw)
        get = lambda path: F.try_variant_get(v, path, "string")
        args = F.to_json(F.try_variant_get(v, "$.arguments", "variant"))
        return F.struct(get("$.id").alias("id"), get("$.name").alias("name"), args.alias("arguments"))

    is_assistant, is_tool = F.col("role") == "assistant", F.col("role") == "tool"
    raws = F.regexp_extract_all("text", F.lit(_CALL), F.lit(1))
    calls = F.filter(F.transform(raws, call), lambda c: c["id"].isNotNull())
    some = F.col("text").contains("<tool_call>")
    m = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    m = m.withColumn("calls", F.when(is_assistant & some, calls).otherwise(F.array().cast(_CALL_TYPE)))
    has = F.coalesce(is_tool & F.col("text").rlike(_RESULT), F.lit(False))
    whole = F.size("calls") == F.size(raws)
    content = F.when(F.coalesce((F.size("calls") > 0) & whole, F.lit(False)), F.trim(F.regexp_replace("text", _CALL, ""))).otherwise(F.col("text"))
    own = lambda call_id, text: F.struct(call_id.cast("string").alias("call_id"), text.alias("content"))
    ids, texts = (F.regexp_extract_all("text", F.lit(_RESULT), F.lit(k)) for k in (1, 2))
    around = F.trim(F.regexp_replace("text", _RESULT, ""))
    results = F.transform(F.arrays_zip(ids.alias("i"), texts.alias("t")), lambda x: own(x["i"], x["t"]))
    results = F.concat(results, F.when(around.rlike(r"\S"), F.array(own(F.lit(None), around))).otherwise(F.array().cast("array<struct<call_id:string,content:string>>")))
    rows = F.when(has, results).otherwise(F.array(own(F.lit(None), content)))
    return m.select("conv_id", "turn", "role", "text", "calls", F.posexplode(rows).alias("part", "r")).select("conv_id", "turn", "role", "text", "calls", "part", "r.call_id", "r.content")


def references(arguments: Column) -> Column:
    """Identifiers of the results that a call's arguments refer to: strings of the form "$result:ID"."""
    return F.array_distinct(F.regexp_extract_all(arguments, F.lit(_REFERENCE), F.lit(1)))


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, at, step, cyclic) of nodes(node, own) so that each comes after those that edges(before, after) name.

    A node stands at its own place (step 0), or, where one before it stands there or later, one
    step behind the last such. Nodes are settled in rounds, each round those whose predecessors
    all are; a round is written out, so lineage does not grow with the depth. Nodes that are
    never free, on a cycle or behind one, keep their own place and are marked cyclic.
    """
    left = materialize(nodes.select("node", "own"), "order-left")
    edges = materialize(edges.select("before", "after").where("before is not null and after is not null").distinct(), "order-edges")
    done, last = None, lambda d: F.struct(d["at"], d["step"])
    while True:
        waiting = edges.join(left.select(F.col("node").alias("before")), "before", "left_semi").select(F.col("after").alias("node")).distinct()
        free = left.join(waiting, "node", "left_anti")
        if done is None:
            settled = free.select("node", F.col("own").alias("at"), F.lit(0).cast("long").alias("step"), F.lit(False).alias("cyclic"))
        else:
            latest = edges.join(done.select(F.col("node").alias("before"), last(done).alias("p")), "before").groupBy(F.col("after").alias("node")).agg(F.max("p").alias("p"))
            behind = F.coalesce(F.col("p.at") >= F.col("own"), F.lit(False)) | (F.col("p.at").isNotNull() & F.col("own").isNull())
            settled = free.join(latest, "node", "left").select("node", F.when(behind, F.col("p.at")).otherwise(F.col("own")).alias("at"), F.when(behind, F.col("p.step") + 1).otherwise(0).cast("long").alias("step"), F.lit(False).alias("cyclic"))
        settled = materialize(settled, "order-settled")
        done = settled if done is None else materialize(done.unionByName(settled), "order-done")
        rest = materialize(left.join(settled, "node", "left_anti"), "order-left")
        stuck, left = settled.isEmpty(), rest
        if stuck or rest.isEmpty():
            return done.unionByName(left.select("node", F.col("own").alias("at"), F.lit(0).cast("long").alias("step"), F.lit(True).alias("cyclic")))


def check_arguments(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls(key columns.., name, arguments) with `valid`: true, false, or null for a tool without a schema.

    schemas(tool, parameter, type, required): one row a parameter; parameter null for a tool
    without any. Arguments must be a JSON object with all required parameters, none that the
    schema lacks, and values of their types. Null arguments are no object; a null name is a tool
    without a schema; key columns, of any name, may be null, and rows equal in all of them are
    judged as one; empty tables give an empty result, or null for every call.
    """
    tools = schemas.select(F.col("tool").alias("name")).distinct().withColumn("known", F.lit(True))
    needed = schemas.where("parameter is not null and required").groupBy(F.col("tool").alias("name")).agg(F.array_sort(F.collect_set("parameter")).alias("needed"))
    c = calls.join(tools, "name", "left").join(needed, "name", "left")
    v = F.try_parse_json("arguments")
    c = c.withColumn("is_object", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    c = c.withColumn("have", F.when(F.col("is_object"), F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))))
    complete = F.size(F.array_except(F.coalesce("needed", F.array().cast("array<string>")), "have")) == 0
    keys = [x for x in calls.columns if x not in ("name", "arguments")]
    typed = c.where("known and is_object").select(*keys, "name", F.explode(F.from_json("arguments", "map<string,variant>")).alias("parameter", "value"))
    s = schemas.select(F.col("tool").alias("name"), "parameter", F.col("type").alias("want"))
    kind = F.schema_of_variant("value")
    right = F.lit(False)
    for name, pattern in _TYPES.items():
        right = right | ((F.col("want") == name) & kind.rlike(f"^(?:{pattern})$"))
    wrong = typed.join(s, ["name", "parameter"], "left").where(F.col("want").isNull() | ~F.coalesce(right, F.lit(False)))
    wrong = wrong.select(*[F.col(k).alias("__" + k) for k in keys]).distinct().withColumn("wrong", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("__" + k))
    c = c.join(wrong, same, "left")
    valid = F.when(F.col("known"), F.coalesce(F.col("is_object") & complete & F.col("wrong").isNull(), F.lit(False)))
    return c.select(*calls.columns, valid.alias("valid"))


def format_chat(parsed: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Each row of parse_messages' result, linked, ordered, checked and serialised.

    Returns conv_id, turn, part, role, order_turn and order_step (sort by conv_id, order_turn,
    order_step, turn, part), cyclic, n_calls, n_answered (calls with a result), n_invalid (calls
    whose arguments break their schema), linked (a result's call exists; null for other rows),
    json and rendered.

    A result comes after its call, and a message whose call refers to a result (see references)
    after that result: rows keep their own turn where they can, and otherwise stand some steps
    behind the last row that they need. Rows on or behind a cycle keep their own turn and are
    marked. The first call of an identifier in a conversation, by turn and place, is the one
    results link to, and the first result the one that references mean. Messages without a
    conv_id are one conversation, those without a turn one turn of theirs, placed last. Null
    roles are 'user', null contents empty. Rows that repeat stay apart; extra columns are
    ignored; an empty table stays empty.
    """
    # Structs are equal where both fields are null, as plain keys of a join are not.
    m = parsed.select("conv_id", "turn", F.col("part").cast("long").alias("part"), F.struct("conv_id").alias("c"), F.struct("turn", F.col("part").cast("long").alias("part")).alias("t"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("content", F.lit("")).alias("content"), "calls", "call_id")
    calls = m.where(F.size("calls") > 0).select("c", "t", "turn", F.posexplode("calls").alias("place", "call")).select("c", "t", "turn", "place", "call.*")
    order = lambda turn: F.coalesce(turn, F.lit(_NO_TURN))
    first = calls.groupBy("c", "id").agg(F.min_by("t", F.struct(order(F.col("turn")), "place")).alias("call_t"), F.lit(True).alias("called"))
    results = m.where("call_id is not null").groupBy("c", F.col("call_id").alias("id")).agg(F.min_by("t", F.struct(order(F.col("turn")), "part")).alias("result_t"))
    answered = first.join(results.select("c", "id", F.lit(1).alias("answered")), ["c", "id"], "left")
    checked = calls.select("c", "t", "place", "id", "name", "arguments")
    checked = check_arguments(checked, schemas) if schemas is not None else checked.withColumn("valid", F.lit(None).cast("boolean"))
    per = (
        checked.join(answered.select("c", "id", "answered"), ["c", "id"], "left")
        .groupBy("c", "t", "place", "id").agg(F.max("answered").alias("answered"), F.max((~F.col("valid")).cast("int")).alias("invalid"))
        .groupBy("c", "t").agg(F.sum("answered").alias("n_answered"), F.sum("invalid").alias("n_invalid"))
    )
    m = m.join(first.select("c", F.col("id").alias("call_id"), "called"), ["c", "call_id"], "left")
    talk, acts = m.where(F.size("calls") == 0), m.where(F.size("calls") > 0)
    m = talk.withColumns({"n_answered": F.lit(0).cast("long"), "n_invalid": F.lit(0).cast("long")}).unionByName(acts.join(per, ["c", "t"], "left"))
    # Rows that take part in links; all others stand at their own turn.
    node = lambda t: F.struct("c", F.col(t).alias("t"))
    returned = m.where("call_id is not null").join(first.select("c", F.col("id").alias("call_id"), "call_t"), ["c", "call_id"])
    edges = returned.select(node("call_t").alias("before"), node("t").alias("after"))
    asked = calls.select("c", "t", F.explode(references(F.col("arguments"))).alias("id")).join(results, ["c", "id"])
    edges = edges.unionByName(asked.select(node("result_t").alias("before"), node("t").alias("after")))
    edges = materialize(edges, "order-links")
    if edges.isEmpty():
        m = m.withColumns({"at": F.lit(None).cast("long"), "step": F.lit(None).cast("long"), "cyclic": F.lit(None).cast("boolean")})
    else:
        nodes = edges.select(F.col("before").alias("node")).unionByName(edges.select(F.col("after").alias("node"))).distinct()
        placed = topological(nodes.withColumn("own", order(F.col("node.t.turn"))), edges)
        m = m.join(placed.select(F.col("node.c").alias("c"), F.col("node.t").alias("t"), "at", "step", "cyclic"), ["c", "t"], "left")
    is_result = F.col("call_id").isNotNull()
    linked = F.when(is_result, F.coalesce("called", F.lit(False)))
    call_json = lambda c: F.struct(F.coalesce(F.try_parse_json(c["arguments"]), F.parse_json(F.lit("null"))).alias("arguments"), c["id"].alias("id"), c["name"].alias("name"))
    body = F.to_json(
        F.struct("content", "role", F.when(is_result, F.col("call_id")).alias("tool_call_id"), F.when(F.size("calls") > 0, F.transform("calls", call_json)).alias("tool_calls")),
        {"ignoreNullFields": "true"},
    )
    shown = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("content"), F.array_join(F.transform("calls", lambda c: F.concat(F.lit("\n<tool_call>"), F.to_json(call_json(c)), F.lit("</tool_call>"))), ""), F.lit("<|end|>\n"))
    return m.select(
        "conv_id", "turn", "part", "role",
        F.coalesce(F.nullif("at", F.lit(_NO_TURN)), "turn").alias("order_turn"),
        F.coalesce("step", F.lit(0)).cast("long").alias("order_step"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        F.size("calls").cast("long").alias("n_calls"),
        F.coalesce("n_answered", F.lit(0)).cast("long").alias("n_answered"),
        F.coalesce("n_invalid", F.lit(0)).cast("long").alias("n_invalid"),
        linked.alias("linked"), body.alias("json"), shown.alias("rendered"),
    )
