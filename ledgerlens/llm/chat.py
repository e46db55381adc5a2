"""Chat formatting: tool calls linked to their results, checked against schemas, ordered, and written as canonical JSON.

Everything is joins, aggregations and array functions of Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import materialize

MESSAGE = "conv_id long, turn long, role string, text string, call struct<id:string,name:string,arguments:map<string,string>>, result_of string, after array<string>"
#: JSON numbers and literals, as text that schema types are checked against.
NUMBER, INTEGER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$", r"^-?(0|[1-9][0-9]*)$"


def quoted(x):
    """A JSON string of a column: quotes, backslashes and control characters escaped."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(x, F.lit("")).alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (conv_id, id) with their topological level: 0, or one more than the highest level before it.

    Nodes on cycles or behind them get level null. Chains, whose nodes have one before them with nothing else behind it,
    are first shortened to their heads by pointer doubling; then one round of joins for each level of what is left.
    """
    edges = materialize(edges.select("conv_id", "from", "to").distinct())
    ways_out = edges.groupBy("conv_id", "from").agg(F.count("*").alias("n_out"))
    ways_in = edges.groupBy("conv_id", "to").agg(F.count("*").alias("n_in"))
    single = edges.join(ways_out.where("n_out = 1"), ["conv_id", "from"]).join(ways_in.where("n_in = 1"), ["conv_id", "to"])
    # (id, head, far): id lies `far` levels behind head; open while head is within a chain itself, for ever on a cycle
    chain = materialize(single.select("conv_id", F.col("to").alias("id"), F.col("from").alias("head"), F.lit(1).cast("long").alias("far")))
    longest = chain.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):
        ahead = chain.select("conv_id", F.col("id").alias("head"), F.col("head").alias("next"), F.col("far").alias("more"))
        chain = materialize(chain.join(ahead, ["conv_id", "head"], "left").select("conv_id", "id", F.coalesce("next", "head").alias("head"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved")))
        if chain.where("moved").isEmpty():
            break

    inner = chain.select("conv_id", "id")
    heads = materialize(nodes.join(inner, ["conv_id", "id"], "left_anti"))
    left = edges.join(inner.withColumnRenamed("id", "to"), ["conv_id", "to"], "left_anti").join(chain.withColumnRenamed("id", "from"), ["conv_id", "from"], "left")
    left = materialize(left.select("conv_id", F.coalesce("head", "from").alias("from"), "to", (F.coalesce("far", F.lit(0)) + 1).alias("far")))
    newest = materialize(heads.join(left.select("conv_id", F.col("to").alias("id")).distinct(), ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0).cast("long")))
    done, least = newest, newest.limit(0)  # least: the level that a waiting node has at least
    rounds = 0
    while not left.isEmpty() and not newest.isEmpty():
        by = newest.withColumnRenamed("id", "from")
        reached = left.join(by, ["conv_id", "from"]).select("conv_id", F.col("to").alias("id"), (F.col("level") + F.col("far")).alias("level"))
        least = materialize(least.unionByName(reached).groupBy("conv_id", "id").agg(F.max("level").alias("level")))
        left = materialize(left.join(by, ["conv_id", "from"], "left_anti"))
        newest = materialize(least.join(left.select("conv_id", F.col("to").alias("id")).distinct(), ["conv_id", "id"], "left_anti"))
        least = least.join(newest.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
        done, rounds = done.unionByName(newest), rounds + 1
        if rounds % 32 == 0:
            done = materialize(done)
    done = materialize(done)
    behind = chain.join(done.withColumnRenamed("id", "head"), ["conv_id", "head"]).select("conv_id", "id", (F.col("level") + F.col("far")).alias("level"))
    return nodes.join(done.unionByName(behind).select("conv_id", "id", F.col("level").cast("int").alias("level")), ["conv_id", "id"], "left")


def format_messages(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each row of `messages` (the columns of MESSAGE), in canonical form.

    schemas: (name, argument, type, required): type is string, integer, number or boolean. Returns conv_id, turn, role,
    level, call_id, linked, valid, error and json.

    A row with a call is a tool call, one with result_of is the result of the call of that id in its conversation;
    others are plain. `after` names calls or results (`result:<id>`) that must come before the row's call. Order within
    a conversation is by (level, turn, call_id): level is the topological level, null for rows on or behind a cycle.
    linked: a call has a result, or a result has its call (null for plain rows). Of several calls with one id the first by turn
    is linked and checked, the others get the error `repeated id`. valid: a call's tool is known, no required argument
    is missing, none is unknown, and each has its type; error names the first violation in the order of argument names.
    A result without a call is an `orphan`. json has its keys in order and no spaces; arguments are sorted by name,
    numbers and booleans that the schema declares stand bare. Several schema rows of one argument are one: the first
    type by name, required if one says so; a null type fits nothing. Nulls: a null conv_id groups with nothing (its rows are
    plain or orphans), null text is "", a null id makes a call with the error `no id`. Empty tables give empty ones;
    extra columns are ignored; rows that repeat are answered each.
    """
    m = messages.select("conv_id", "turn", "role", "text", "call", "result_of", "after").withColumn("kind", F.when(F.col("call").isNotNull(), "call").when(F.col("result_of").isNotNull(), "result").otherwise("plain"))
    m = m.withColumn("id", F.when(F.col("kind") == "call", F.col("call.id")).when(F.col("kind") == "result", F.concat(F.lit("result:"), "result_of")))
    m = materialize(m)

    # links: one row for each call id and each result id of a conversation
    calls = m.where("kind = 'call' and id is not null and conv_id is not null").groupBy("conv_id", F.col("id").alias("call_id")).agg(F.min("turn").alias("first_turn"))
    results = m.where("kind = 'result' and conv_id is not null").select("conv_id", F.col("result_of").alias("call_id")).distinct()
    both = calls.join(results.withColumn("has_result", F.lit(True)), ["conv_id", "call_id"], "full")
    links = both.select("conv_id", "call_id", "first_turn", F.col("first_turn").isNotNull().alias("has_call"), F.coalesce("has_result", F.lit(False)).alias("has_result"))

    # levels of call and result nodes
    nodes = m.where("id is not null and conv_id is not null").select("conv_id", "id").distinct()
    pairs = links.where("has_call and has_result").select("conv_id", F.col("call_id").alias("from"), F.concat(F.lit("result:"), "call_id").alias("to"))
    named = m.where("kind = 'call' and conv_id is not null and id is not null").select("conv_id", F.explode("after").alias("from"), F.col("id").alias("to")).where("`from` is not null")
    named = named.join(nodes.select("conv_id", F.col("id").alias("from")), ["conv_id", "from"], "left_semi")
    levels = _levels(nodes, pairs.unionByName(named))

    # the schema of a tool as a map of its arguments, small per tool
    rules = schemas.where("name is not null and argument is not null").groupBy("name", "argument").agg(F.min("type").alias("type"), F.coalesce(F.bool_or("required"), F.lit(False)).alias("required"))
    tools = rules.groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("argument", F.struct("type", "required").alias("rule"))))).alias("rules"))
    m = m.withColumn("name", F.col("call.name")).withColumn("call_id", F.when(F.col("kind") == "call", F.col("id")).when(F.col("kind") == "result", F.col("result_of")))
    out = m.join(links, ["conv_id", "call_id"], "left").join(levels, ["conv_id", "id"], "left").join(tools, "name", "left")

    args = F.coalesce(F.col("call.arguments"), F.create_map().cast("map<string,string>"))
    keys = F.array_sort(F.map_keys(args))
    rule = lambda k: F.element_at("rules", k)
    typed = lambda t, v: F.when(v.isNull(), F.lit(False)).when(t == "string", F.lit(True)).when(t == "integer", v.rlike(INTEGER)).when(t == "number", v.rlike(NUMBER)).when(t == "boolean", v.isin("true", "false")).otherwise(F.lit(False))
    every = F.array_sort(F.array_union(keys, F.coalesce(F.map_keys("rules"), F.array().cast("array<string>"))))
    fault = lambda k: (
        F.when(rule(k).isNull(), F.concat(F.lit("unknown argument "), k))
        .when(~F.map_contains_key(args, k), F.when(rule(k)["required"], F.concat(F.lit("missing argument "), k)))
        .when(~typed(rule(k)["type"], F.element_at(args, k)), F.concat(F.lit("wrong type of "), k))
    )
    faults = F.filter(F.transform(every, fault), lambda x: x.isNotNull())
    error = F.when(
        F.col("kind") == "call",
        F.when(F.col("id").isNull(), "no id").when(F.col("first_turn") < F.col("turn"), "repeated id").when(F.col("rules").isNull(), "unknown tool").otherwise(F.get(faults, F.lit(0))),
    ).when((F.col("kind") == "result") & ~F.coalesce("has_call", F.lit(False)), "orphan")
    bare = lambda k: F.coalesce(rule(k)["type"] != "string", F.lit(False)) & typed(rule(k)["type"], F.element_at(args, k))
    pairs_json = F.transform(keys, lambda k: F.concat(quoted(k), F.lit(":"), F.when(F.element_at(args, k).isNull(), F.lit("null")).when(bare(k), F.element_at(args, k)).otherwise(quoted(F.element_at(args, k)))))
    call_json = F.concat(F.lit('"call":{"arguments":{'), F.array_join(pairs_json, ","), F.lit('},"id":'), quoted(F.col("id")), F.lit(',"name":'), quoted(F.col("name")), F.lit("},"))
    json = F.concat(
        F.lit("{"),
        F.when(F.col("kind") == "call", call_json).otherwise(""),
        F.lit('"content":'),
        quoted(F.col("text")),
        F.when(F.col("kind") == "result", F.concat(F.lit(',"result_of":'), quoted(F.col("result_of")))).otherwise(""),
        F.lit(',"role":'),
        quoted(F.col("role")),
        F.lit("}"),
    )
    linked = F.when(F.col("kind") == "call", F.coalesce(F.col("has_result") & F.col("has_call"), F.lit(False)) & F.coalesce(F.col("first_turn") == F.col("turn"), F.lit(False))).when(F.col("kind") == "result", F.coalesce("has_call", F.lit(False)))
    level = F.when(F.col("kind") == "plain", F.lit(0)).otherwise(F.col("level"))
    return out.select("conv_id", "turn", "role", level.alias("level"), "call_id", linked.alias("linked"), F.when(F.col("kind") == "call", error.isNull()).alias("valid"), error.alias("error"), json.alias("json"))


def as_calls(conversations: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as messages of MESSAGE's form.

    A user turn becomes a call, an assistant turn the result of the call of the turn before it, a system turn stays plain.
    Each call comes after the result of the call two turns before, so conversations are chains of as many levels as turns.
    Arguments are the text, the turn and the number of words; by that number modulo 5 the turn is no integer (0), the
    words are missing (1), there is an argument too many (2), or the tool is unknown (3).
    """
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    turn, kind, query = F.col("turn").cast("string"), words % 5, F.coalesce("text", F.lit(""))
    given = lambda *names: F.map_from_arrays(F.array(*(F.lit(n) for n, _ in names)), F.array(*(v for _, v in names)))
    q, t, w, e = ("query", query), ("turn", turn), ("words", words.cast("string")), ("extra", F.lit("1"))
    arguments = F.when(kind == 0, given(q, ("turn", F.concat(F.lit("x"), turn)), w)).when(kind == 1, given(q, t)).when(kind == 2, given(q, t, w, e)).otherwise(given(q, t, w))
    name = F.when(kind == 3, F.lit("unheard")).otherwise(F.lit("answer"))
    call = F.when(user, F.struct(F.concat(F.lit("t"), turn).alias("id"), name.alias("name"), arguments.alias("arguments")))
    result = F.when(assistant, F.concat(F.lit("t"), (F.col("turn") - 1).cast("string")))
    after = F.when(user, F.array(F.concat(F.lit("result:t"), (F.col("turn") - 2).cast("string"))))
    return conversations.select("conv_id", "turn", "role", "text", call.alias("call"), result.alias("result_of"), after.alias("after"))
