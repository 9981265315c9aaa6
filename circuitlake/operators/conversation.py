"""Conversations and agent trajectories: validation, reshaping, tool-call extraction, profiles.

All operators are expressions over arrays of messages or windows over steps, so they run
inside generated code; no Python workers.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circuitlake.functions import mathx

ROLES = ("system", "user", "assistant", "tool")

# The tools an agent may call, with the arguments each requires.
CONTRACT = (
    ("sim.dc", ["netlist"]),
    ("sim.ac", ["netlist"]),
    ("sim.tran", ["netlist"]),
    ("sim.noise", ["netlist", "output_node", "input_source"]),
    ("sim.stb", ["netlist", "probe_node"]),
    ("sim.corners", ["netlist", "corners"]),
    ("sim.mc", ["netlist", "num_runs"]),
    ("meas.eval", ["signal", "expression"]),
    ("spec.check", ["results", "specs"]),
    ("pdk.device_query", ["model", "W", "L", "VGS", "VDS"]),
    ("pdk.list_devices", []),
    ("pdk.get_corners", []),
    ("netlist.patch", ["operations"]),
    ("lint.check", ["netlist"]),
    ("opt.suggest", ["netlist", "variables", "objectives"]),
)
SYSTEM_PROMPT = "You are a circuit design assistant. Use the tools you are given and never invent results."
CALL = r"(?s)<tool_call>(.*?)</tool_call>"


def contract(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(n, a) for n, a in CONTRACT], "name string, required array<string>"))


def system_message(prompt: str = SYSTEM_PROMPT, tools: tuple = CONTRACT) -> str:
    """The one system message of training and serving: the prompt and a section per tool with its required arguments."""
    parts = [prompt, "# Tools"]
    for name, required in tools:
        parts.append("\n".join([f"## {name}", *(f"- {a} (required)" for a in required)]))
    return "\n\n".join(parts)


def tool_names(tools: tuple = CONTRACT) -> list[str]:
    return sorted(name for name, _ in tools)


def call_grammar(names: list[str]) -> str:
    """Grammar of replies that may only call the named tools: prose with tagged JSON calls.

    No names would forbid every call and are refused.
    """
    if not names:
        raise ValueError("a grammar without tools forbids every call")
    quoted = " | ".join('"' + json.dumps(n).replace('"', '\\"') + '"' for n in names)
    rules = {
        "root": "text (call text)*",
        "text": "[^<]*",
        "call": '"<tool_call>" ws "{" ws "\\"name\\"" ws ":" ws tool ws "," ws "\\"arguments\\"" ws ":" ws object ws "}" ws "</tool_call>"',
        "tool": quoted,
        "object": '"{" ws (pair (ws "," ws pair)*)? ws "}"',
        "pair": "string ws \":\" ws value",
        "array": '"[" ws (value (ws "," ws value)*)? ws "]"',
        "value": 'string | number | object | array | "true" | "false" | "null"',
        "string": '"\\"" ([^"\\\\] | "\\\\" .)* "\\""',
        "number": '"-"? [0-9]+ ("." [0-9]+)? ([eE] [-+]? [0-9]+)?',
        "ws": "[ \\t\\n\\r]*",
    }
    return "\n".join(f"{name} ::= {rule}" for name, rule in rules.items())


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def content(m: Column) -> Column:
    return F.coalesce(m["content"], F.lit(""))


# --- JSON bodies of tool calls


def lenient_json(body: Column) -> Column:
    """The body if it is JSON; else without trailing commas; else with single quotes turned
    double when it has no double quotes; null if nothing parses."""
    fixed = F.regexp_replace(body, r",\s*([}\]])", "$1")
    quoted = F.when(~F.contains(fixed, F.lit('"')) & F.contains(fixed, F.lit("'")), F.replace(fixed, F.lit("'"), F.lit('"')))

    def parsed(x: Column) -> Column:
        return F.when(F.try_parse_json(x).isNotNull(), x)

    return F.coalesce(parsed(body), parsed(fixed), parsed(quoted))


def tool_bodies(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CALL), 1), strip)


def parse_calls(messages: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """One row per canonical call in a text: position, body, JSON, name, arguments, error, thinking.

    error: not_json, not_object, no_name, bad_arguments or null. Texts without canonical
    calls fall back to `<function=name>{...}</function>`, whose broken arguments are {}.
    """
    bodies = messages.select(*keys, text, F.posexplode(tool_bodies(F.col(text))).alias("call", "body"))
    parsed = bodies.withColumn("json", lenient_json(F.col("body")))
    name, args = F.get_json_object("json", "$.name"), F.get_json_object("json", "$.arguments")
    error = (
        F.when(F.col("json").isNull(), "not_json")
        .when(~F.startswith(strip(F.col("json")), F.lit("{")), "not_object")
        .when(name.isNull() | (name == ""), "no_name")
        .when(args.isNotNull() & ~F.startswith(strip(args), F.lit("{")), "bad_arguments")
    )
    before = strip(F.substring_index(F.col(text), "<tool_call>", 1))
    canonical = parsed.select(
        *keys, "call", F.lit("chatml").alias("method"), F.when(error.isNull(), name).alias("name"),
        F.when(error.isNull(), F.coalesce(args, F.lit("{}"))).alias("arguments"), error.alias("error"),
        F.length(before).cast("long").alias("thinking_chars"),
    )
    legacy = r"(?s)<function=([^>]+)>(.*?)</function>"
    plain = messages.filter(~F.col(text).rlike(CALL) & F.col(text).rlike(legacy))
    tags = F.arrays_zip(F.regexp_extract_all(text, F.lit(legacy), 1).alias("name"), F.regexp_extract_all(text, F.lit(legacy), 2).alias("args"))
    rows = plain.select(*keys, text, F.posexplode(tags).alias("call", "tag"))
    body = lenient_json(strip(F.col("tag")["args"]))
    old = rows.select(
        *keys, "call", F.lit("xml").alias("method"), strip(F.col("tag")["name"]).alias("name"),
        F.when(F.startswith(body, F.lit("{")), body).otherwise("{}").alias("arguments"), F.lit(None).cast("string").alias("error"),
        F.length(strip(F.substring_index(F.col(text), "<function=", 1))).cast("long").alias("thinking_chars"),
    )
    return canonical.unionByName(old)


def first_call(text: Column) -> Column:
    """Loosest reading of a reply, as (name, source): the first canonical call, else a
    loose name and arguments object, else the first contract tool that is mentioned."""
    body = F.regexp_extract(text, r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>", 1)
    canonical = F.when(F.try_parse_json(F.nullif(body, F.lit(""))).isNotNull(), F.get_json_object(body, "$.name"))
    loose = F.nullif(F.regexp_extract(text, r'(?s)\{[^{}]*"name"\s*:\s*"([\w.]+)"[^{}]*"arguments"\s*:\s*\{[^{}]*\}', 1), F.lit(""))
    mentioned = F.coalesce(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n, _ in CONTRACT])
    source = F.when(canonical.isNotNull(), "canonical").when(loose.isNotNull(), "loose").when(mentioned.isNotNull(), "mention")
    return F.struct(F.coalesce(canonical, loose, mentioned).alias("name"), source.alias("source"))


def check_calls(calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, reason): unknown_tool or missing_argument of parsed calls (name, arguments)."""
    spark = calls.sparkSession
    given = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    joined = calls.join(contract(spark), "name", "left").withColumn("missing", F.array_except("required", given))
    reason = F.when(F.col("required").isNull(), "unknown_tool").when(F.size("missing") > 0, "missing_argument")
    return joined.withColumn("reason", reason).filter("reason is not null").select(*keys, "name", "reason")


def hallucinated(calls: DataFrame) -> DataFrame:
    """Tools called that no contract knows, with counts."""
    return calls.join(contract(calls.sparkSession), "name", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("calls"))


def signature(text: Column) -> Column:
    """Shape of a text: string pairs and number pairs replaced, blanks squeezed, 200 characters."""
    t = F.regexp_replace(text, r'"[^"]*":\s*"[^"]*"', '"K": "V"')
    t = F.regexp_replace(t, r'"[^"]*":\s*[\d.]+', '"K": 0')
    return F.substring(F.regexp_replace(t, r"\s+", " "), 1, 200)


# --- message arrays


def chat_errors(messages: str = "messages") -> Column:
    """Codes of everything wrong with a chat, in message order; an empty array is a valid chat."""
    m = F.col(messages)
    first = F.try_element_at(m, F.lit(1))
    head = F.array(
        F.when(~F.coalesce(first["role"] == "system", F.lit(False)), "first_not_system"),
        F.when(F.length(first["content"]) > 0, F.when(~F.contains(F.lower(first["content"]), F.lit("circuit")), "no_circuit_context")),
    )

    def one(x: Column, i: Column) -> Column:
        role, text = x["role"], content(x)
        before = F.try_element_at(m, F.when(i > 0, i).otherwise(1))["role"]
        has, closed = F.contains(text, F.lit("<tool_call>")), F.contains(text, F.lit("</tool_call>"))
        body = F.regexp_extract(text, CALL, 1)
        good = F.try_parse_json(body).isNotNull()
        call = (role == "assistant") & has
        return F.array(
            F.when(role.isNull(), "no_role"),
            F.when(~role.isin(*ROLES), "bad_role"),
            F.when((role == "tool") & (i > 0) & ~F.coalesce(before.isin("assistant", "tool"), F.lit(False)), "stray_tool"),
            F.when(call & ~closed, "open_call"),
            F.when(call & closed & ~good, "bad_json"),
            F.when(call & closed & good & F.get_json_object(body, "$.name").isNull(), "no_name"),
            F.when(call & closed & good & F.get_json_object(body, "$.arguments").isNull(), "no_arguments"),
        )

    rest = F.flatten(F.transform(m, one))
    return F.when(F.coalesce(F.size(m), F.lit(0)) <= 0, F.array(F.lit("empty"))).otherwise(F.array_compact(F.concat(head, rest)))


def normalize_action(messages: str = "messages", prompt: str = SYSTEM_PROMPT) -> Column:
    m = F.col(messages)
    first = F.try_element_at(m, F.lit(1))
    return (
        F.when(m.isNull() | (F.size(m) <= 0), "no_messages")
        .when(~F.coalesce(first["role"] == "system", F.lit(False)), "inserted")
        .when(first["content"] == prompt, "already_canonical")
        .otherwise("rewritten")
    )


def normalized(messages: str = "messages", prompt: str = SYSTEM_PROMPT) -> Column:
    """Messages with the canonical system message first."""
    m, action = F.col(messages), normalize_action(messages, prompt)
    head = F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")))
    return F.when(action == "no_messages", m).when(action == "inserted", F.concat(head, m)).otherwise(F.concat(head, F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))))


def for_training(messages: str = "messages", prompt: str = SYSTEM_PROMPT) -> Column:
    """Canonical system message and all messages that are not system ones."""
    head = F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")))
    return F.concat(head, F.filter(messages, lambda m: ~F.coalesce(m["role"] == "system", F.lit(False))))


def chat_text(messages: Column) -> Column:
    """One string in the ChatML layout."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), F.coalesce(m["role"], F.lit("")), F.lit("\n"), content(m), F.lit("<|im_end|>\n")))
    return F.array_join(parts, "")


def fits(messages: str = "messages", tokens: int = 4096) -> Column:
    """Whether the whole chat's estimated tokens fit."""
    return mathx.token_estimate(F.length(chat_text(F.col(messages)))) <= tokens


def task_prompt(category: Column, description: Column, supply: Column, load: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Task category: "), category), description, F.concat(F.lit("Supply: "), supply.cast("string")), F.concat(F.lit("Load: "), load))


# --- aggregates over chats


def analyze(rows: DataFrame, by: str = "source") -> DataFrame:
    """Examples, successes, percentages and sizes per group and in total (rollup)."""
    chars = F.aggregate(F.coalesce("messages", F.array().cast(rows.schema["messages"].dataType)), F.lit(0).cast("long"), lambda a, m: a + F.length(content(m)))
    roles = F.concat_ws(",", F.transform("messages", lambda m: F.coalesce(m["role"], F.lit("?"))))
    flat = rows.select(by, "success", "score", F.greatest(F.coalesce(F.size("messages"), F.lit(0)), F.lit(0)).alias("n"), chars.alias("chars"), roles.alias("roles"))
    return flat.rollup(by).agg(
        F.grouping(by).alias("is_total"),
        F.count(F.lit(1)).alias("examples"),
        F.count_if(F.coalesce("success", F.lit(False))).alias("successes"),
        F.round(100.0 * F.count_if(F.coalesce("success", F.lit(False))) / F.count(F.lit(1)), 1).alias("success_pct"),
        F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("mean_score"),
        F.round(F.avg("n"), 6).alias("mean_messages"),
        F.sum("chars").alias("chars"),
        mathx.token_estimate(F.sum("chars")).alias("tokens"),
        F.countDistinct("roles").alias("role_patterns"),
    )


def tool_usage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Occurrences of `"name": "x"` in assistant messages with tool calls, with a bar of at most 40 marks."""
    texts = rows.select(*by, F.explode(F.filter("messages", lambda m: (m["role"] == "assistant") & F.contains(content(m), F.lit("<tool_call>")))).alias("m"))
    names = texts.select(*by, F.explode(F.regexp_extract_all(F.col("m.content"), F.lit(r'"name"\s*:\s*"([^"]+)"'), 1)).alias("tool"))
    counts = names.groupBy(*by, "tool").agg(F.count(F.lit(1)).alias("uses"))
    return counts.withColumn("bar", F.repeat(F.lit("#"), F.least(F.lit(40), F.col("uses")).cast("int")))


# --- trajectories of single steps


def step_errors(steps: DataFrame) -> DataFrame:
    """(run_id, step, error) of steps (run_id, step, role, action, observation).

    bad_role; tool_without_result; call_by_other (a call that is not the assistant's);
    bad_call (a call without name or arguments); early_tool (a tool step before any
    assistant step of the run, found by the run's first assistant step, not by a sort).
    """
    first = steps.filter("role = 'assistant'").groupBy("run_id").agg(F.min("step").alias("first"))
    rows = steps.join(first, "run_id", "left").withColumn("seen", F.coalesce(F.col("step") >= F.col("first"), F.lit(False)))
    errors = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "bad_role"),
            F.when((F.col("role") == "tool") & F.col("observation").isNull(), "tool_without_result"),
            F.when(F.col("action").isNotNull() & (F.col("role") != "assistant"), "call_by_other"),
            F.when(F.col("action").isNotNull() & (F.col("action.name").isNull() | F.col("action.arguments").isNull()), "bad_call"),
            F.when((F.col("role") == "tool") & ~F.col("seen"), "early_tool"),
        )
    )
    return rows.select("run_id", "step", F.explode(errors).alias("error"))


def dataset_report(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: trajectories, invalid ones, errors, the most frequent error's count."""
    bad = errors.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    per = runs.select("run_id").distinct().join(bad, "run_id", "left")
    totals = per.agg(F.count(F.lit(1)).alias("runs"), F.count("n").alias("invalid"), F.coalesce(F.sum("n"), F.lit(0)).alias("errors"))
    most = errors.groupBy("error").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_frequent"))
    return totals.crossJoin(most)  # one row each


def first_errors(errors: Column, n: int = 20) -> Column:
    """The first n of a list of errors, and how many there are (the limit is the feature)."""
    return F.struct(F.slice(errors, 1, n).alias("first"), F.size(errors).alias("total"))


def to_chat(steps: DataFrame) -> DataFrame:
    """Chat message of every step: a result becomes the content, an action a tool call, both in the
    text and as a list of calls with ids that the run and step make."""
    call = F.when(F.col("action").isNotNull(), F.concat(F.lit("\n<tool_call>"), F.to_json(F.struct("action.name", "action.arguments")), F.lit("</tool_call>")))
    text = F.concat(F.coalesce("observation", "content", F.lit("")), F.coalesce(call, F.lit("")))
    entry = F.struct(F.concat_ws("_", F.lit("call"), "run_id", "step").alias("id"), F.col("action.name").alias("name"), F.to_json("action.arguments").alias("arguments"))
    calls = F.when(F.col("action").isNotNull(), F.array(entry)).otherwise(F.array().cast("array<struct<id:string,name:string,arguments:string>>"))
    return steps.select("run_id", "step", "role", text.alias("content"), F.col("action.name").alias("tool"), calls.alias("tool_calls"))


def trajectory_statistics(steps: DataFrame) -> DataFrame:
    """One row: runs, share that ended done, mean steps, mean of the runs' summed rewards."""
    reward = F.when(~F.isnan("reward"), F.col("reward"))
    per = steps.groupBy("run_id").agg(F.max(F.coalesce("done", F.lit(False))).alias("ok"), F.count(F.lit(1)).alias("n"), F.sum(reward).alias("total"))
    return per.agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"), F.round(F.avg("n"), 6).alias("mean_steps"), F.round(F.avg("total"), 6).alias("mean_reward")
    )
