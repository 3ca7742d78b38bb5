"""Chat formatting: linking tool calls to results, ordering, validation and canonical JSON.

An assistant message may be a JSON object with ``tool_calls`` (a list of ``id``, ``name``,
``arguments`` and optionally ``after``, ids of calls that come first) and ``content``. A message of role
``tool`` is an object with ``tool_call_id`` and ``content``. All other messages are plain text.

Calls and results are hash-joined by conversation and id, and so are calls and the calls they name in
``after``. Messages stand in the order of turns, so a call of an earlier message comes first anyway, one
of a later message cannot, and what is left to order are the calls of one message, by levels: a call
stands one level above the calls of its message that it names. That is done within the row, whatever
the length of chains through the conversation. Arguments are variants: types are read from
them and checked against the tools' schemas, and written with sorted keys.

Nothing gathers a conversation: the result has one row for each message, ordered by (``conv_id``,
``turn``), with the calls of its JSON ordered by level and place. Defined results: null texts have null
content. A null ``conv_id`` is a conversation like any other. Calls without an id stay, unlinked; without
a name, invalid. Of repeated call ids the first by (turn, position) counts and the others are duplicates
without a result; of several results the first. A result must come in a later turn. Arguments that are
a string with the JSON of an object are that object. Unknown tools and arguments that are no object are invalid. A name in ``after`` is unmet if no call of this message or of
one with a smaller turn has it. Calls on a cycle, and those that wait for one, have no level and come last.
Broken JSON is plain text; fields that are named nowhere here are not kept. Repeated rows are numbered
when written. An empty table gives an empty result. Other columns are not looked at.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm.columns import let
from netlens.storage import materialize

#: Tools and their arguments: (JSON types that fit, required).
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True), "precise": ("boolean", False)},
    "convert": {"amount": ("number", True), "unit": ("string", True), "options": ("object", False)},
    "list": {"items": ("array", True)},
}
# JSON types as the type names of variants begin.
TYPE_NAMES = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DECIMAL", "DOUBLE"],
    "boolean": ["BOOLEAN"],
    "object": ["OBJECT"],
    "array": ["ARRAY"],
}

CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:variant,after:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:variant>"


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with ``calls`` and ``result`` where their text has them."""
    body = F.ltrim("text")
    calls = F.when(
        (F.col("role") == "assistant") & body.startswith("{") & F.contains("text", F.lit('"tool_calls"')),
        F.from_json("text", CALLS),
    )
    result = F.when((F.col("role") == "tool") & body.startswith("{"), F.from_json("text", RESULT))
    numbered = messages.select(
        F.monotonically_increasing_id().alias("row"),
        "conv_id",
        "turn",
        "role",
        "text",
        calls.alias("calls"),
        result.alias("result"),
    )
    some = F.size(F.filter("calls.tool_calls", lambda c: c.isNotNull())) > 0
    return numbered.select(
        "row", "conv_id", "turn", "role", "text", F.col("calls.content").alias("content"),
        F.when(some, F.filter("calls.tool_calls", lambda c: c.isNotNull())).alias("calls"),
        F.when(F.col("result.tool_call_id").isNotNull(), F.col("result")).alias("result"),
    )


def fits(arguments: Column, name: Column) -> Column:
    """Whether the arguments fit the schema of the tool."""
    kind = F.schema_of_variant(arguments)
    out = F.lit(False)
    for tool, fields in TOOLS.items():
        each = []
        for field, (wanted, required) in fields.items():
            value = F.schema_of_variant(F.try_variant_get(arguments, f"$.{field}", "variant"))
            right = F.coalesce(F.regexp_like(value, F.lit("^(" + "|".join(TYPE_NAMES[wanted]) + ")")), F.lit(not required))
            each.append(right)
        known = F.coalesce(
            F.size(F.array_except(F.map_keys(arguments.cast("map<string,variant>")), F.array(*map(F.lit, fields)))) == 0,
            F.lit(False),
        )
        fit = known
        for x in each:
            fit = fit & x
        out = F.when(
            name == tool,
            F.when(F.coalesce(kind.startswith("OBJECT"), F.lit(False)), fit).otherwise(False),
        ).otherwise(out)
    return F.coalesce(out, F.lit(False))


def unquoted(arguments: Column) -> Column:
    """Arguments, or the object that they hold if they are a string with the JSON of one."""
    held = F.try_parse_json(F.try_variant_get(arguments, "$", "string"))
    quoted = (F.schema_of_variant(arguments) == "STRING") & F.schema_of_variant(held).startswith("OBJECT")
    return F.when(F.coalesce(quoted, F.lit(False)), held).otherwise(arguments)


def calls_of(found: DataFrame) -> DataFrame:
    """One row for each call: its message, place, and whether it is the first of its id."""
    rows = found.where(F.size("calls") > 0).select("row", "conv_id", "turn", F.posexplode("calls").alias("place", "c"))
    calls = rows.select(
        "row",
        "conv_id",
        "turn",
        "place",
        F.col("c.id").alias("id"),
        F.col("c.name").alias("name"),
        unquoted(F.col("c.arguments")).alias("arguments"),
        F.coalesce("c.after", F.array().cast("array<string>")).alias("after"),
    )
    return calls.withColumn("valid", fits(F.col("arguments"), F.col("name")))


def linked(calls: DataFrame, found: DataFrame) -> DataFrame:
    """Calls with ``first`` (of its id), ``result_turn`` (null without a later result), ``n_unmet``, the names in
    ``after`` that are of no call before it, and ``needs``, the places of those that are of its own message."""
    named = calls.where(F.col("id").isNotNull())
    first = named.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row", "place")).alias("f")).select(
        F.col("conv_id").alias("of"),
        F.col("id").alias("named"),
        F.col("f.turn").alias("first_turn"),
        F.col("f.row").alias("first_row"),
        F.col("f.place").alias("first_place"),
    )
    results = found.where(F.col("result").isNotNull()).select(
        F.col("conv_id").alias("in"),
        F.col("result.tool_call_id").alias("answers"),
        F.col("turn").alias("at"),
    )
    match = first["of"].eqNullSafe(results["in"]) & (first["named"] == results["answers"]) & (results["at"] > first["first_turn"])
    answered = first.join(results, match, "left").groupBy("of", "named").agg(
        F.min("at").alias("result_turn"),
        F.min("first_turn").alias("first_turn"),
        F.min("first_row").alias("first_row"),
        F.min("first_place").alias("first_place"),
    )
    answered = materialize(answered, "call-ids")
    marked = calls.join(answered, calls["conv_id"].eqNullSafe(answered["of"]) & (calls["id"] == answered["named"]), "left")
    is_first = F.coalesce((F.col("first_row") == F.col("row")) & (F.col("first_place") == F.col("place")), F.lit(False))
    marked = marked.select(*calls.columns, is_first.alias("first"), F.when(is_first, F.col("result_turn")).alias("result_turn"))
    needs = calls.select("row", "conv_id", "turn", "place", F.explode(F.array_distinct("after")).alias("needs"))
    targets = answered.select("of", "named", "first_turn", "first_row", "first_place")
    met = needs.join(targets, needs["conv_id"].eqNullSafe(targets["of"]) & (needs["needs"] == targets["named"]), "left")
    before = F.coalesce((F.col("first_row") == F.col("row")) | (F.col("first_turn") < F.col("turn")), F.lit(False))
    # Places of the calls of the same message that a call names; the join finds them, no search within the row.
    within = F.collect_list(F.when(F.col("first_row") == F.col("row"), F.col("first_place")))
    of_call = met.groupBy("row", "place").agg(F.count_if(~before).alias("n_unmet"), F.sort_array(within).alias("needs"))
    whole = marked.join(of_call, ["row", "place"], "left").na.fill({"n_unmet": 0})
    return whole.withColumn("needs", F.coalesce("needs", F.array().cast("array<int>")))


def levels(needs: Column) -> Column:
    """The level of each call of a message, in order of place; null on a cycle and above one.

    ``needs``: for each call the places of those that it names. If none names more than one, each call's way down is doubled
    in each round, so that a chain takes as many rounds as its length has binary digits. Otherwise a call gets its level in
    the round after the last of those that it names, and rounds without a change do nothing: work is calls times levels.
    """
    return let(
        needs,
        lambda each: F.when(F.forall(each, lambda need: F.size(need) <= 1), chain_levels(each)).otherwise(round_levels(each)),
    )


def chain_levels(needs: Column) -> Column:
    """Levels where a call names at most one: steps down to the end of its chain, if there is one."""
    start = F.transform(
        needs,
        lambda need: F.struct(F.get(need, F.lit(0)).alias("to"), F.size(need).alias("steps")),
    )

    def further(way: Column, at: Column) -> Column:
        next_one = F.struct(at["to"].alias("to"), (way["steps"] + at["steps"]).alias("steps"))
        return F.when(way["to"].isNull(), way).otherwise(next_one)

    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(needs).cast("long"))))
    ends = F.aggregate(rounds, start, lambda held, _: F.transform(held, lambda way: further(way, F.get(held, way["to"]))))
    return F.transform(ends, lambda way: F.when(way["to"].isNull(), way["steps"]))


def round_levels(needs: Column) -> Column:
    """Levels by rounds, until one changes nothing."""
    start = F.transform(needs, lambda need: F.when(F.size(need) == 0, F.lit(0)))

    def level(held: Column, need: Column, i: Column) -> Column:
        known = F.forall(need, lambda k: F.get(held, k).isNotNull())
        return F.coalesce(
            F.get(held, i),
            F.when(known, F.array_max(F.transform(need, lambda k: F.get(held, k))) + 1),
        )

    def one_round(state: Column) -> Column:
        open_ones = lambda made: F.size(F.filter(made, lambda x: x.isNull()))
        return let(
            F.transform(needs, lambda need, i: level(state["held"], need, i)),
            lambda made: F.struct(
                made.alias("held"), open_ones(made).alias("open"), (open_ones(made) < state["open"]).alias("busy")
            ),
        )

    first = F.struct(start.alias("held"), F.size(needs).alias("open"), F.lit(True).alias("busy"))
    # A round copies its state even if it does nothing, so rounds come in blocks and idle blocks have none.
    block = F.sequence(F.lit(1), F.ceil(F.sqrt(F.size(needs))).cast("int"))

    def one_block(state: Column) -> Column:
        rounds = F.when(state["busy"], block).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rounds, state, lambda held, _: F.when(held["busy"], one_round(held)).otherwise(held))

    return F.aggregate(block, first, lambda state, _: one_block(state), lambda state: state["held"])


def format_chat(messages: DataFrame) -> DataFrame:
    """One row for each message (``conv_id``, ``turn``, ``role``): its canonical ``json`` and counts of calls that are
    linked, valid, duplicate or cyclic, and of names in ``after`` that are unmet; ``level``, the highest of its calls (for a result, of the call it answers)."""
    found = materialize(parsed(messages.select("conv_id", "turn", "role", "text")), "chat-messages")
    each = materialize(linked(calls_of(found), found), "chat-calls")
    # The calls of a message were one row and are one again.
    call = F.struct(
        "place",
        "id",
        "needs",
        "first",
        "valid",
        "result_turn",
        "n_unmet",
        F.to_json(F.struct("after", F.to_json("arguments").alias("arguments"), "id", "name")).alias("json"),
    )
    gathered = each.groupBy("row").agg(F.sort_array(F.collect_list(call)).alias("calls"))
    ordered = gathered.select("row", "calls", levels(F.col("calls.needs")).alias("levels"))
    sums = materialize(ordered.select(
        "row", "calls", "levels",
        F.size("calls").cast("long").alias("n_calls"),
        *(F.size(F.filter("calls", test)).cast("long").alias(name) for name, test in {
            "n_linked": lambda c: c["result_turn"].isNotNull(),
            "n_valid": lambda c: c["valid"],
            "n_duplicate": lambda c: c["id"].isNotNull() & ~c["first"],
        }.items()),
        F.size(F.filter("levels", lambda x: x.isNull())).cast("long").alias("n_cyclic"),
        F.aggregate("calls", F.lit(0).cast("long"), lambda n, c: n + c["n_unmet"]).alias("n_unmet"),
        F.array_max("levels").alias("level"),
        F.array_join(
            F.transform(
                F.sort_array(
                    F.zip_with(
                        "calls",
                        "levels",
                        lambda c, x: F.struct(
                            F.coalesce(x, F.lit(1 << 30)).alias("by"),
                            c["place"].alias("place"),
                            c["json"].alias("json"),
                        ),
                    )
                ),
                lambda c: c["json"],
            ),
            ",",
        ).alias("made"),
    ), "chat-ordered")
    answers = each.where("first").select(
        F.col("conv_id").alias("of"),
        F.col("id").alias("named"),
        F.col("row").alias("call_row"),
        "place",
        "result_turn",
    )
    each_level = sums.select(F.col("row").alias("call_row"), F.posexplode("levels").alias("place", "answered_level"))
    at_level = answers.join(each_level, ["call_row", "place"]).select(
        "of",
        "named",
        "answered_level",
        F.col("result_turn").alias("answered_turn"),
    )
    results = found.where(F.col("result").isNotNull()).select(
        F.col("row").alias("result_row"),
        "conv_id",
        F.col("result.tool_call_id").alias("id"),
    )
    linked_results = results.join(
        at_level,
        results["conv_id"].eqNullSafe(at_level["of"]) & (results["id"] == at_level["named"]),
    ).select(F.col("result_row").alias("row"), "answered_level", "answered_turn")
    whole = found.join(sums.drop("calls", "levels"), "row", "left").join(linked_results, "row", "left")
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    content = F.to_json(F.array("content"), {"ignoreNullFields": "false"})
    with_calls = F.concat(
        F.lit('{"content":'),
        F.substring(content, F.lit(2), F.length(content) - 2),
        F.lit(',"role":"assistant","tool_calls":['),
        F.col("made"),
        F.lit("]}"),
    )
    with_result = F.concat(
        F.lit('{"content":'),
        F.coalesce(F.to_json("result.content"), F.lit("null")),
        F.lit(',"role":"tool",'),
        F.to_json(F.struct(F.col("result.tool_call_id").alias("tool_call_id"))).substr(F.lit(2), F.lit(1 << 30)),
    )
    counts = ("n_calls", "n_linked", "n_valid", "n_duplicate", "n_cyclic", "n_unmet")
    return whole.select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("made").isNotNull(), with_calls).when(
            F.col("result").isNotNull(),
            with_result,
        ).otherwise(plain).alias("json"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        (F.col("answered_turn") == F.col("turn")).alias("is_answer"),
        F.coalesce("level", "answered_level").alias("level"),
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The driver's table has no tool calls: every message is plain.
ORACLE = """
SELECT conv_id, turn, role, CAST(to_json({'content': text, 'role': role}) AS VARCHAR) AS json,
  CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_valid, CAST(0 AS BIGINT) AS n_duplicate, CAST(0 AS BIGINT) AS n_cyclic, CAST(0 AS BIGINT) AS n_unmet,
  CAST(NULL AS BOOLEAN) AS is_answer, CAST(NULL AS INTEGER) AS level
FROM conversations"""
