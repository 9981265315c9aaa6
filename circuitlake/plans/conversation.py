"""Conversation queries over demo_output (chats) and rl_ngspice_demo (trajectories)."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlake.operators import conversation as conv
from circuitlake.runtime import table


def _chats(spark, d):
    return table(spark, d, "demo_output").select("id", "messages", "source", "success", "score")


def _texts(spark, d):
    return _chats(spark, d).distinct().select("id", F.posexplode("messages").alias("pos", "m")).select("id", "pos", "m.role", "m.content")


def _steps(spark, d):
    rows = table(spark, d, "rl_ngspice_demo")
    kept = F.struct("role", "content", "action", "observation", "reward", "done")
    return rows.groupBy("run_id", "step").agg(F.min_by(kept, "received_at").alias("r")).select("run_id", "step", "r.*")


def _calls(spark, d):
    return conv.parse_calls(_texts(spark, d), ["id", "pos"])


def chat_errors(spark, d):
    return _chats(spark, d).select("id", F.array_join(conv.chat_errors(), ",").alias("errors"))


def normalize(spark, d):
    rows = _chats(spark, d).select("source", conv.normalize_action().alias("action"))
    return rows.groupBy("source").pivot("action", ["no_messages", "inserted", "already_canonical", "rewritten"]).count().na.fill(0)


def normalized(spark, d):
    return _chats(spark, d).select("id", F.size(conv.normalized()).alias("n"), F.md5(conv.chat_text(conv.normalized())).alias("digest"))


def training_text(spark, d):
    return _chats(spark, d).select("id", F.md5(conv.chat_text(conv.for_training())).alias("digest"), conv.fits(tokens=512).alias("fits"))


def signatures(spark, d):
    rows = _texts(spark, d).filter("role = 'assistant' and contains(content, '<tool_call>')")
    return rows.groupBy(F.md5(conv.signature(F.col("content"))).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


def first_calls(spark, d):
    rows = _texts(spark, d).filter("role = 'assistant' and content is not null")
    return rows.select("id", "pos", conv.first_call(F.col("content")).alias("c")).select("id", "pos", "c.*")


def to_chat(spark, d):
    rows = conv.to_chat(_steps(spark, d))
    call = F.contains("content", F.lit("<tool_call>"))
    text = F.regexp_replace("content", r"(?s)\n<tool_call>\{\"name.*$", "")
    return rows.select("run_id", "step", "role", "tool", call.alias("call"), F.md5(text).alias("digest"), F.try_element_at("tool_calls", F.lit(1))["id"].alias("call_id"), F.size("tool_calls").alias("calls"))


def prompts(spark, d):
    t = table(spark, d, "eval_task")
    return t.select("id", conv.task_prompt(F.col("category"), F.col("description"), F.when(~F.isnan("supply"), F.format_number("supply", 2)), F.col("load")).alias("prompt"))


QUERIES = {
    "conv_success": lambda spark, d: _chats(spark, d).filter("success").select("id", "source"),
    "conv_chat_errors": chat_errors,
    "conv_normalize_counts": normalize,
    "conv_normalized": normalized,
    "conv_training_text": training_text,
    "conv_signatures": signatures,
    "conv_tool_calls": lambda spark, d: _calls(spark, d).select("id", "pos", "call", "method", "name", "error", "thinking_chars"),
    "conv_first_call": first_calls,
    "conv_call_checks": lambda spark, d: conv.check_calls(_calls(spark, d).filter("error is null"), ["id", "pos", "call"]),
    "conv_hallucinated": lambda spark, d: conv.hallucinated(_calls(spark, d).filter("error is null")),
    "conv_analyze": lambda spark, d: conv.analyze(_chats(spark, d)),
    "conv_tool_usage": lambda spark, d: conv.tool_usage(_chats(spark, d), ["source"]),
    "conv_step_errors": lambda spark, d: conv.step_errors(_steps(spark, d)),
    "conv_dataset_report": lambda spark, d: conv.dataset_report(_steps(spark, d), conv.step_errors(_steps(spark, d))),
    "conv_to_chat": to_chat,
    "conv_statistics": lambda spark, d: conv.trajectory_statistics(_steps(spark, d)),
    "conv_task_prompts": prompts,
    "conv_tool_names": lambda spark, d: spark.range(1).select(F.lit(",".join(conv.tool_names())).alias("names"), F.lit(len(conv.CONTRACT)).cast("long").alias("n")),
    "conv_system_message": lambda spark, d: spark.range(1).select(F.md5(F.lit(conv.system_message())).alias("digest")),
}

_PROMPT = "You are a circuit design assistant. Use the tools you are given and never invent results."
_TEXTS = """t AS (SELECT id, pos, m.role AS role, m.content AS content FROM (
    SELECT id, unnest(range(len(messages))) AS pos, unnest(messages) AS m FROM (SELECT DISTINCT id, messages, source, success, score FROM demo_output)))"""
_STEPS = "s AS (SELECT * FROM rl_ngspice_demo QUALIFY row_number() OVER (PARTITION BY run_id, step ORDER BY received_at) = 1)"
_FIX = r"""CASE WHEN json_valid(body) THEN body
      WHEN json_valid(regexp_replace(body, ',\s*([}\]])', '\1', 'g')) THEN regexp_replace(body, ',\s*([}\]])', '\1', 'g')
      WHEN NOT contains(body, '"') AND json_valid(replace(regexp_replace(body, ',\s*([}\]])', '\1', 'g'), chr(39), '"')) THEN replace(regexp_replace(body, ',\s*([}\]])', '\1', 'g'), chr(39), '"') END"""
_CALLS = rf"""{_TEXTS},
  b AS (SELECT id, pos, content, unnest(range(len(l))) AS call, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS body
        FROM (SELECT *, regexp_extract_all(content, '(?s)<tool_call>(.*?)</tool_call>', 1) AS l FROM t)),
  j AS (SELECT *, {_FIX} AS js FROM b),
  c AS (SELECT id, pos, call, 'chatml' AS method, length(regexp_replace(split_part(content, '<tool_call>', 1), '^\s+|\s+$', '', 'g')) AS thinking_chars, js,
          CASE WHEN js IS NULL THEN 'not_json' WHEN NOT starts_with(js, '{{') THEN 'not_object' WHEN coalesce(json_extract_string(js, '$.name'), '') = '' THEN 'no_name'
               WHEN json_extract(js, '$.arguments') IS NOT NULL AND json_type(js, '$.arguments') <> 'OBJECT' THEN 'bad_arguments' END AS error FROM j),
  k AS (SELECT *, CASE WHEN error IS NULL THEN json_extract_string(js, '$.name') END AS name FROM c)"""
_CONTRACT = """contract(pos, name, required) AS (VALUES (1, 'sim.dc', ['netlist']), (2, 'sim.ac', ['netlist']), (3, 'sim.tran', ['netlist']),
  (4, 'sim.noise', ['netlist', 'output_node', 'input_source']), (5, 'sim.stb', ['netlist', 'probe_node']), (6, 'sim.corners', ['netlist', 'corners']), (7, 'sim.mc', ['netlist', 'num_runs']),
  (8, 'meas.eval', ['signal', 'expression']), (9, 'spec.check', ['results', 'specs']), (10, 'pdk.device_query', ['model', 'W', 'L', 'VGS', 'VDS']), (11, 'pdk.list_devices', []::VARCHAR[]),
  (12, 'pdk.get_corners', []::VARCHAR[]), (13, 'netlist.patch', ['operations']), (14, 'lint.check', ['netlist']), (15, 'opt.suggest', ['netlist', 'variables', 'objectives']))"""
_NORM = f"""CASE WHEN messages IS NULL OR len(messages) = 0 THEN 'no_messages' WHEN coalesce(messages[1].role, '') <> 'system' THEN 'inserted'
      WHEN messages[1].content = '{_PROMPT}' THEN 'already_canonical' ELSE 'rewritten' END"""
_CHAT = "list_aggregate(list_transform({l}, lambda m: '<|im_start|>' || coalesce(m.role, '') || chr(10) || coalesce(m.content, '') || '<|im_end|>' || chr(10)), 'string_agg', '')"
_HEAD = f"[{{'role': 'system', 'content': '{_PROMPT}'}}]"

SQL = {
    "conv_success": "SELECT id, source FROM demo_output WHERE success",
    "conv_chat_errors": rf"""WITH x AS (SELECT row_number() OVER () AS k, id, messages FROM demo_output),
  m AS (SELECT k, i, messages[i] AS m, messages[i - 1].role AS before FROM (SELECT k, messages, unnest(range(1, len(messages) + 1)) AS i FROM x)),
  p AS (SELECT k, i, m.role AS role, before, coalesce(m.content, '') AS c, regexp_extract(coalesce(m.content, ''), '(?s)<tool_call>(.*?)</tool_call>', 1) AS body FROM m),
  f AS (SELECT *, role = 'assistant' AND contains(c, '<tool_call>') AS call, contains(c, '</tool_call>') AS closed, body <> '' AND json_valid(body) AS good FROM p),
  e AS (
    SELECT k, i, 1 AS o, 'no_role' AS e FROM f WHERE role IS NULL
    UNION ALL SELECT k, i, 2, 'bad_role' FROM f WHERE role NOT IN ('system', 'user', 'assistant', 'tool')
    UNION ALL SELECT k, i, 3, 'stray_tool' FROM f WHERE role = 'tool' AND i > 1 AND coalesce(before, '') NOT IN ('assistant', 'tool')
    UNION ALL SELECT k, i, 4, 'open_call' FROM f WHERE call AND NOT closed
    UNION ALL SELECT k, i, 5, 'bad_json' FROM f WHERE call AND closed AND NOT good
    UNION ALL SELECT k, i, 6, 'no_name' FROM f WHERE call AND closed AND good AND json_extract(body, '$.name') IS NULL
    UNION ALL SELECT k, i, 7, 'no_arguments' FROM f WHERE call AND closed AND good AND json_extract(body, '$.arguments') IS NULL
    UNION ALL SELECT k, 0, 0, 'first_not_system' FROM x WHERE len(messages) > 0 AND coalesce(messages[1].role, '') <> 'system'
    UNION ALL SELECT k, 0, 1, 'no_circuit_context' FROM x WHERE len(messages) > 0 AND length(messages[1].content) > 0 AND NOT contains(lower(messages[1].content), 'circuit')
    UNION ALL SELECT k, 0, 0, 'empty' FROM x WHERE messages IS NULL OR len(messages) = 0)
SELECT x.id, coalesce(string_agg(e, ',' ORDER BY i, o), '') AS errors FROM x LEFT JOIN e USING (k) GROUP BY x.k, x.id""",
    "conv_normalize_counts": f"""SELECT source, count(*) FILTER (a = 'no_messages') AS no_messages, count(*) FILTER (a = 'inserted') AS inserted,
  count(*) FILTER (a = 'already_canonical') AS already_canonical, count(*) FILTER (a = 'rewritten') AS rewritten FROM (SELECT source, {_NORM} AS a FROM demo_output) GROUP BY source""",
    "conv_normalized": f"""WITH n AS (SELECT id, CASE {_NORM} WHEN 'no_messages' THEN messages WHEN 'inserted' THEN list_concat({_HEAD}, messages) ELSE list_concat({_HEAD}, messages[2:]) END AS l FROM demo_output)
SELECT id, len(l) AS n, md5(CASE WHEN len(l) = 0 THEN '' ELSE {_CHAT.format(l="l")} END) AS digest FROM n""",
    "conv_training_text": f"""WITH n AS (SELECT id, CASE WHEN messages IS NOT NULL THEN list_concat({_HEAD}, list_filter(messages, lambda m: coalesce(m.role, '') <> 'system')) END AS l, messages AS raw FROM demo_output)
SELECT id, md5({_CHAT.format(l="l")}) AS digest, length(CASE WHEN len(raw) = 0 THEN '' ELSE {_CHAT.format(l="raw")} END) // 4 <= 512 AS fits FROM n""",
    "conv_signatures": rf"""WITH {_TEXTS} SELECT md5(substr(regexp_replace(regexp_replace(regexp_replace(content, '"[^"]*":\s*"[^"]*"', '"K": "V"', 'g'), '"[^"]*":\s*[\d.]+', '"K": 0', 'g'), '\s+', ' ', 'g'), 1, 200)) AS signature, count(*) AS n
FROM t WHERE role = 'assistant' AND contains(content, '<tool_call>') GROUP BY 1""",
    "conv_tool_calls": f"WITH {_CALLS} SELECT id, pos, call, method, name, error, thinking_chars FROM k",
    "conv_first_call": rf"""WITH {_TEXTS}, {_CONTRACT}, r AS (SELECT id, pos, content, regexp_extract(content, '(?s)<tool_call>\s*(\{{.*?\}})\s*</tool_call>', 1) AS body,
    nullif(regexp_extract(content, '(?s)\{{[^{{}}]*"name"\s*:\s*"([\w.]+)"[^{{}}]*"arguments"\s*:\s*\{{[^{{}}]*\}}', 1), '') AS loose FROM t WHERE role = 'assistant' AND content IS NOT NULL),
  x AS (SELECT id, pos, CASE WHEN body <> '' AND json_valid(body) THEN json_extract_string(body, '$.name') END AS canonical, loose,
    (SELECT arg_min(name, contract.pos) FROM contract WHERE contains(r.content, name)) AS mention FROM r)
SELECT id, pos, coalesce(canonical, loose, mention) AS name, CASE WHEN canonical IS NOT NULL THEN 'canonical' WHEN loose IS NOT NULL THEN 'loose' WHEN mention IS NOT NULL THEN 'mention' END AS source FROM x""",
    "conv_call_checks": f"""WITH {_CALLS}, {_CONTRACT}
SELECT id, k.pos, call, k.name, CASE WHEN required IS NULL THEN 'unknown_tool' ELSE 'missing_argument' END AS reason
FROM k LEFT JOIN contract USING (name) WHERE error IS NULL AND (required IS NULL OR NOT list_has_all(coalesce(json_keys(js, '$.arguments'), []), required))""",
    "conv_hallucinated": f"WITH {_CALLS}, {_CONTRACT} SELECT name, count(*) AS calls FROM k WHERE error IS NULL AND name NOT IN (SELECT name FROM contract) GROUP BY name",
    "conv_analyze": """WITH f AS (SELECT source, coalesce(success, false) AS ok, coalesce(score, 0) AS score, coalesce(len(messages), 0) AS n,
    coalesce(list_sum(list_transform(messages, lambda m: length(coalesce(m.content, '')))), 0) AS chars, coalesce(list_aggregate(list_transform(messages, lambda m: coalesce(m.role, '?')), 'string_agg', ','), '') AS roles FROM demo_output)
SELECT source, grouping(source) AS is_total, count(*) AS examples, count(*) FILTER (ok) AS successes, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 1) AS success_pct, round(avg(score), 6) AS mean_score,
  round(avg(n), 6) AS mean_messages, sum(chars)::BIGINT AS chars, (sum(chars) // 4)::BIGINT AS tokens, count(DISTINCT roles) AS role_patterns FROM f GROUP BY ROLLUP(source)""",
    "conv_tool_usage": r"""WITH x AS (SELECT source, unnest(messages) AS m FROM demo_output), n AS (SELECT source, unnest(regexp_extract_all(m.content, '"name"\s*:\s*"([^"]+)"', 1)) AS tool FROM x WHERE m.role = 'assistant' AND contains(m.content, '<tool_call>'))
SELECT source, tool, count(*) AS uses, repeat('#', least(40, count(*))::INT) AS bar FROM n GROUP BY ALL""",
    "conv_step_errors": f"""WITH {_STEPS}, w AS (SELECT *, coalesce(max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING), 0) = 1 AS seen FROM s)
SELECT run_id, step, 'bad_role' AS error FROM w WHERE coalesce(role, '') NOT IN ('system', 'user', 'assistant', 'tool')
UNION ALL SELECT run_id, step, 'tool_without_result' FROM w WHERE role = 'tool' AND observation IS NULL
UNION ALL SELECT run_id, step, 'call_by_other' FROM w WHERE action IS NOT NULL AND role <> 'assistant'
UNION ALL SELECT run_id, step, 'bad_call' FROM w WHERE action IS NOT NULL AND (action.name IS NULL OR action.arguments IS NULL)
UNION ALL SELECT run_id, step, 'early_tool' FROM w WHERE role = 'tool' AND NOT seen""",
    "conv_statistics": f"""WITH {_STEPS}, p AS (SELECT run_id, bool_or(coalesce(done, false)) AS ok, count(*) AS n, sum(CASE WHEN NOT isnan(reward) THEN reward END) AS total FROM s GROUP BY run_id)
SELECT count(*) AS runs, round(avg(ok::INT), 6) AS success_rate, round(avg(n), 6) AS mean_steps, round(avg(total), 6) AS mean_reward FROM p""",
    "conv_task_prompts": """SELECT id, concat_ws(chr(10), 'Task category: ' || category, description, CASE WHEN NOT isnan(supply) THEN 'Supply: ' || printf('%.2f', supply) END, 'Load: ' || load) AS prompt FROM eval_task""",
}
SQL["conv_to_chat"] = f"""WITH {_STEPS}, x AS (SELECT *, coalesce(observation, content, '') AS t FROM s)
SELECT run_id, step, role, action.name AS tool, action IS NOT NULL OR contains(t, '<tool_call>') AS call, md5(t) AS digest,
  CASE WHEN action IS NOT NULL THEN 'call_' || run_id || '_' || step END AS call_id, (action IS NOT NULL)::INT AS calls FROM x"""
SQL["conv_tool_names"] = f"WITH {_CONTRACT} SELECT string_agg(name, ',' ORDER BY name) AS names, count(*) AS n FROM contract"
SQL["conv_system_message"] = f"""WITH {_CONTRACT} SELECT md5('{_PROMPT}' || chr(10) || chr(10) || '# Tools' || string_agg(chr(10) || chr(10) || '## ' || name ||
  coalesce(list_aggregate(list_transform(required, lambda a: chr(10) || '- ' || a || ' (required)'), 'string_agg', ''), ''), '' ORDER BY pos)) AS digest FROM contract"""
_se = SQL["conv_step_errors"]
SQL["conv_dataset_report"] = f"""WITH e AS ({_se}), b AS (SELECT run_id, count(*) AS n FROM e GROUP BY 1), r AS (SELECT DISTINCT run_id FROM rl_ngspice_demo)
SELECT count(*) AS runs, count(n) AS invalid, coalesce(sum(n), 0)::BIGINT AS errors, coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY error)), 0)::BIGINT AS most_frequent FROM r LEFT JOIN b USING (run_id)"""
