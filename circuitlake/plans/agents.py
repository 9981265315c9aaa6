"""Queries of context assembly, checks, deck elements, corners, sizing and scripted generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlake.operators import conversation as conv
from circuitlake.operators import evaluation, retrieval, scoring, search
from circuitlake.operators import netlists as net
from circuitlake.operators import results as res
from circuitlake.operators import signals as sig
from circuitlake.plans import scoring as score_plans
from circuitlake.plans.netlists import _D, _L, _SC, _decks
from circuitlake.runtime import table


def _contexts(spark, d):
    t = table(spark, d, "eval_task").select(F.col("id").alias("task"), F.col("pdk").alias("notes"))
    n = table(spark, d, "task_alias").filter("old_id is not null and new_id is not null").select(
        F.col("new_id").alias("task"), F.col("old_id").alias("other"), (F.length("old_id") / 37.0).alias("similarity"), (F.length("old_id") % 2 == 0).alias("success"), (F.length("new_id") / 17.0).alias("score")
    )
    return retrieval.context(t, n.distinct(), 3, 0.2)


def prompts(spark, d):
    t = table(spark, d, "eval_task").select(F.col("id").alias("task"), "description", "load").join(_contexts(spark, d), "task")
    parts = [F.lit(conv.SYSTEM_PROMPT), F.concat(F.lit("## Task\n"), "description"), F.concat(F.lit("## State\n"), "load"), F.col("context"), F.lit("## History\nnone")]
    return t.select("task", F.md5(retrieval.assemble(parts, 160)).alias("digest"))


def _replies(spark, d):
    return table(spark, d, "benchmark").groupBy("id").agg(F.min("model").alias("model"), F.min("response_preview").alias("response"), F.min("overall").alias("overall"))


def totals(spark, d):
    r = _replies(spark, d).select("model", retrieval.token_cost(F.length(F.coalesce("response", F.lit("")))).alias("tokens"), F.when(~F.isnan("overall"), F.round("overall", 3)).alias("seconds"))
    return evaluation.agent_totals(r, ("model",)).select("model", "tokens", F.round("seconds", 3).alias("seconds"))


def statuses(spark, d):
    return evaluation.status_counts(_replies(spark, d).select(F.when(F.col("response").isNull() | (F.trim("response") == ""), "skip").when(F.col("overall") >= 0.5, "ok").otherwise("failed").alias("status")))


def first_errors(spark, d):
    rows = table(spark, d, "demo_output").select("id", conv.first_errors(F.transform("messages", lambda m: F.coalesce(m["role"], F.lit("?"))), 3).alias("e"))
    return rows.filter("e.total >= 0").select("id", F.array_join("e.first", ",").alias("first"), "e.total")


def checks(spark, d):
    specs = score_plans._specs(spark, d).select("task_id", "spec", "low", "high", "target", "weight")
    got = scoring.spec_check(score_plans._nominal(spark, d).withColumnRenamed("actual", "value"), specs)
    return got.select("task_id", F.round("score", 6).alias("score"), "measured", "unmeasurable", "success")


def phases(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("run"), F.posexplode("embedding").alias("x", "y")).select("run", "x", (F.col("y").cast("double") * 2000).alias("y"))
    return sig.normalize_phase(v).groupBy("run").agg(F.round(F.sum("y"), 4).alias("total"), F.round(F.min_by("y", "x"), 4).alias("first"))


def elements(spark, d):
    return net.elements(_decks(spark, d)).groupBy("deck_id", "scope", "letter").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit(":"), F.coalesce("subckt", F.lit("-"))))), ",").alias("names"))


def branches(spark, d):
    decks = _decks(spark, d)
    subckts = net.elements(decks).filter("letter = 'x'").select("deck_id", "scope", F.col("name").alias("instance"), "subckt").distinct()
    srcs = net.sources(decks).groupBy("deck_id", "scope", "name").agg(F.max("dc").alias("dc"))
    top = srcs.filter("scope = ''").select("deck_id", F.concat(F.lit("V."), "name").alias("branch"))
    deep = subckts.filter("scope = ''").select("deck_id", F.concat(F.lit("v."), "instance", F.lit(".vx")).alias("branch"))
    got = net.branch_value(top.union(deep), srcs, subckts)
    return got.select("deck_id", "branch", F.format_string("%.6e", "dc").try_cast("double").alias("dc"))


def corner_decks(spark, d):
    return _decks(spark, d).select("deck_id", F.md5(net.at_corner(F.col("text"), F.lit(125.0))).alias("digest"), net.is_random(F.col("text")).alias("random"))


def templates(spark, d):
    t = table(spark, d, "eval_task").select(F.col("id").alias("name"), "category", F.col("description").alias("text"))
    return net.list_templates(t, "digital").select("name")


def corners(spark, d):
    """Requests of every task against a small corner table."""
    rows = [("sky130", "tt", "TT", 1.8, 27.0), ("sky130", "SS", "SS", 1.62, 125.0), ("sky130", "ff", "FF", 1.98, -40.0)]
    table_ = spark.createDataFrame(rows, "pdk string, corner string, section string, voltage double, temperature double")
    asks = table(spark, d, "eval_task").select("id", F.lit("sky130").alias("pdk"), F.element_at(F.array(F.lit(None), F.lit("ss"), F.lit(" TT"), F.lit("zz")), (F.length("id") % 4 + 1).cast("int")).alias("corner"))
    return res.corner_lookup(asks, table_).select("id", "corner", "section", "voltage", "temperature")


def sizings(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("task"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("candidate"))
    values = F.when(F.col("candidate") == 6, F.create_map(F.lit("other"), F.lit("1"))).otherwise(F.create_map(F.lit("w"), F.concat((F.col("candidate") * (1 + F.col("task") % 4)).cast("string"), F.lit("u"))))
    rows = t.select("task", "candidate", F.lit("M1 d g s b nch W={w} L=1u\nM2 d g s b nch W={w} L=1u").alias("template"), values.alias("values"), (F.lit(20.0) + F.col("task") % 9).alias("low"))
    scored = res.sizing(rows.join(rows.select(F.col("task").alias("t"), F.col("candidate").alias("c"), "low").alias("x").drop("low"), (F.col("task") == F.col("t")) & (F.col("candidate") == F.col("c"))).drop("t", "c", "low"), 20.0 + F.col("task") % 9)
    return res.best_sizing(scored).select("task", "candidate", F.round("gain", 6).alias("gain"), F.round("score", 6).alias("score"))


def picks(spark, d):
    names = F.array(F.lit("v(net1)"), F.lit("V(out)"), F.lit("v1#branch"), F.lit("in"))
    kept = table(spark, d, "supplier").select(F.col("s_suppkey").alias("run"), F.posexplode(names).alias("i", "name")).filter("(run + i) % 3 <> 0")
    out = res.pick_signal(kept).withColumnRenamed("name", "output")
    return out.join(res.pick_signal(kept, names=res.INPUTS, fallback=False).withColumnRenamed("name", "input"), "run", "left")


def pairs(spark, d):
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("run"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i"))
    gain = v.select("run", F.lit("vdb(out)").alias("name"), F.col("i").cast("double").alias("x"), (F.col("run") + F.col("i") * 1.5).alias("y"))
    phase = v.filter("run % 3 <> 0 or i < 5").select("run", F.lit("VP(out)").alias("name"), F.col("i").cast("double").alias("x"), (-1.0 * F.col("i")).alias("y"))
    return res.pair_responses(gain.union(phase))


def axes(spark, d):
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("run"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i"))
    a = v.select("run", F.col("i").cast("double").alias("x"), F.lit(0.0).alias("y"))
    b = v.filter("run % 4 <> 0").select("run", F.when((F.col("run") % 3 == 0) & (F.col("i") == 2), 2.5).otherwise(F.col("i").cast("double")).alias("x"), F.lit(0.0).alias("y"))
    return res.pair_on_axis(a, b)


def provenance(spark, d):
    e = net.elements(_decks(spark, d)).filter("letter = 'v' and scope = ''").select(F.col("deck_id").alias("run"), "name").distinct()
    b = e.union(e.select("run").distinct().filter("run < '8'").select("run", F.lit("vstray")))
    return res.belongs_to_deck(b, e)


def pinned(spark, d):
    p = net.pin_parameters(F.concat("text", F.lit("\nX9 d g s b nfet_01v8 W=1u\nxr a b res\nX8 d g s b nfet_01v8 w=2u mult=3")), "^nfet", {"nf": "1", "mult": "1"})
    return _decks(spark, d).select("deck_id", F.md5(p).alias("digest"))


def noise_kinds(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", F.element_at(F.array(F.lit(".noise V(out) Vin dec 10 1 1g"), F.lit(".NOISE v(a,b) iin lin 5 1 2"), F.lit("* nothing")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("text"))
    return t.select("s_suppkey", net.noise_kinds(F.col("text")).alias("k")).select("s_suppkey", "k.input", "k.output")


def formatted(spark, d):
    p = table(spark, d, "supplier").select("s_suppkey", (F.when(F.col("s_suppkey") % 2 == 0, 1.0).otherwise(-1.0) * (F.col("s_suppkey") % 900 + 1) * F.pow(F.lit(10.0), (F.col("s_suppkey") % 7) * 3.0 - 15)).alias("v"))
    return p.select("s_suppkey", net.formatted("v").alias("text"))


def scripted(spark, d):
    t = table(spark, d, "eval_task").select("id", F.col("category").alias("request"), F.lit("M1 a b c d").alias("netlist"), F.lit("gain 40").alias("result"))
    return res.scripted_trajectory(t, conv.SYSTEM_PROMPT).select("id", F.size("messages").alias("n"), F.md5(conv.chat_text(F.col("messages"))).alias("digest"))


def bounds(spark, d):
    """Bounds lie at a factor of 1.05 to 1.5 from the measured value, on the side it meets; jitter stays in its bounds."""
    m = table(spark, d, "part").select(F.col("p_partkey").alias("run"), F.lit(0).alias("pos"), F.lit("gain").alias("name"), F.col("p_retailprice").alias("value"), (F.col("p_size") % 2 == 0).alias("larger_is_better"))
    s = res.grounded_specs(m, 7).join(m.select("run", "value", "larger_is_better"), "run")
    low = F.col("low").isNotNull() & F.col("high").isNull() & F.col("value").between(F.col("low") * 1.0499, F.col("low") * 1.5001)
    high = F.col("high").isNotNull() & F.col("low").isNull() & F.col("high").between(F.col("value") * 1.0499, F.col("value") * 1.5001)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("task"), F.lit("w").alias("name"), F.col("p_size").cast("double").alias("default"), F.lit(5.0).alias("low"), F.lit(45.0).alias("high"), (F.col("p_size") % 3 == 0).alias("integer"))
    j = res.jitter(p, 0.2, 3)
    ok = F.col("value").between(5.0, 45.0) & (~F.col("integer") | (F.col("value") == F.rint("value"))) & ((F.abs(F.col("value") - F.col("default")) <= 0.2 * F.col("default") + 0.5) | (F.col("default") < 5) | (F.col("default") > 45))
    return s.select(F.col("run").alias("part"), F.when(F.col("larger_is_better"), low).otherwise(high).alias("bounded")).join(j.select(F.col("task").alias("part"), ok.alias("jittered")), "part")


def quick(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("run"), F.posexplode("embedding").alias("i", "y"))
    return sig.quick_metrics(sig.with_next(v.select("run", (F.col("i") + 1.0).alias("x"), (F.col("y").cast("double") * 20).alias("y")), 16.0))


def searched(spark, d):
    """The optimum of a bowl around known values is found to a hundredth of the range."""
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("task"))
    bounds = t.select("task", F.explode(F.array(F.lit("l"), F.lit("w"))).alias("name"), F.lit(0.0).alias("low"), F.lit(10.0).alias("high"))
    goal = F.when(F.col("name") == "w", F.col("task") % 9 + 0.5).otherwise(9.5 - F.col("task") % 7)

    def evaluate(rows):
        total = rows.groupBy("task", "candidate").agg(F.sum(-F.pow(F.col("value") - goal, 2)).alias("score"))
        return rows.join(total, ["task", "candidate"])

    got = search.Shrinking().optimize(bounds, evaluate, 6)
    return got.select("task", "name", (F.abs(F.col("value") - goal) <= 0.1).alias("found"))


QUERIES = {
    "signal_quick": quick, "agent_search": searched, "agent_context": _contexts, "agent_prompts": prompts, "agent_totals": totals, "agent_statuses": statuses, "conv_first_errors": first_errors, "score_spec_check": checks,
    "signal_normalized_phase": phases, "netlist_elements": elements, "netlist_branches": branches, "netlist_corner_decks": corner_decks, "netlist_template_list": templates,
    "result_corners": corners, "result_sizing": sizings, "result_picks": picks, "result_pairs": pairs, "result_axes": axes, "result_provenance": provenance, "netlist_pinned": pinned,
    "netlist_noise_kinds": noise_kinds, "netlist_formatted": formatted, "result_scripted": scripted, "result_bounds": bounds,
    "result_attempts": lambda spark, d: res.attempts(table(spark, d, "eval_task").select("id"), 3),
}

_CTX = r"""n AS (SELECT DISTINCT new_id AS task, old_id AS other, length(old_id) / 37.0::DOUBLE AS s, length(old_id) % 2 = 0 AS ok, length(new_id) / 17.0::DOUBLE AS v FROM task_alias WHERE old_id IS NOT NULL AND new_id IS NOT NULL),
  b AS (SELECT * FROM n WHERE s >= 0.2 QUALIFY row_number() OVER (PARTITION BY task ORDER BY round(s, 9) DESC, other) <= 3),
  l AS (SELECT task, string_agg('- ' || other || ': similarity ' || printf('%.2f', s) || ', ' || CASE WHEN ok THEN 'met' ELSE 'missed' END || ' its specs, score ' || printf('%.3f', v), chr(10) ORDER BY round(s, 9) DESC, other) AS t FROM b GROUP BY task),
  c AS (SELECT id AS task, description, load, CASE WHEN trim(coalesce(pdk, '')) <> '' THEN '## Process' || chr(10) || trim(pdk) || chr(10) || chr(10) ELSE '' END || '## Past designs' || chr(10) || coalesce(t, 'none in memory') AS context FROM eval_task LEFT JOIN l ON l.task = id)"""
_R = "r AS (SELECT id, min(model) AS model, min(response_preview) AS response, min(overall) AS overall FROM benchmark GROUP BY id)"
# cards of decks: comments gone, continuations joined, control blocks and what follows .end left out, scope by the last .subckt or .ends before
_CARDS = _L.replace("string_split(text, chr(10))", r"string_split(regexp_replace(text, '\r?\n[ \t]*\+', ' ', 'g'), chr(10))") + r""",
  c0 AS (SELECT deck_id, line, lower(regexp_replace(regexp_replace(raw, '[;$].*$', ''), '^\s+|\s+$', '', 'g')) AS card FROM l WHERE line > 0),
  c1 AS (SELECT *, CASE WHEN regexp_matches(card, '^\.subckt\s') THEN string_split(trim(regexp_replace(card, '\s+', ' ', 'g')), ' ')[2] WHEN regexp_matches(card, '^\.ends\b') THEN '' END AS mark,
    CASE WHEN starts_with(card, '.control') THEN 1 WHEN starts_with(card, '.endc') THEN 0 END AS ctl, regexp_matches(card, '^\.end\s*$') AS fin FROM c0),
  c2 AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS scope, coalesce(last_value(ctl IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS inside,
    bool_or(fin) OVER (w ROWS UNBOUNDED PRECEDING) AS over FROM c1 WINDOW w AS (PARTITION BY deck_id ORDER BY line)),
  e0 AS (SELECT deck_id, scope, list_filter(string_split(trim(regexp_replace(card, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM c2 WHERE card <> '' AND inside = 0 AND NOT over AND NOT regexp_matches(card, '^[*.]')),
  el AS (SELECT deck_id, scope, t, t[1] AS name, lower(string_split(t[1], '.')[1][1]) AS letter, CASE WHEN lower(string_split(t[1], '.')[1][1]) = 'x' THEN list_filter(t, lambda x: NOT contains(x, '='))[-1] END AS subckt FROM e0)"""
# voltage sources with their operating value; a source is looked for on every line, as the reader does
_SOURCES = _L + r""",
  s0 AS (SELECT deck_id, line, lower(trim(regexp_replace(raw, '[;$].*$', ''))) AS card FROM l),
  s1 AS (SELECT *, CASE WHEN regexp_matches(card, '^\.subckt\s') THEN string_split(trim(regexp_replace(card, '\s+', ' ', 'g')), ' ')[2] WHEN regexp_matches(card, '^\.ends\b') THEN '' END AS mark FROM s0),
  s2 AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY deck_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS scope FROM s1),
  s3 AS (SELECT deck_id, scope, string_split(regexp_replace(card, '\s+', ' ', 'g'), ' ') AS t FROM s2 WHERE regexp_matches(card, '^v\S*\s+\S+\s+\S+')),
  s4 AS (SELECT deck_id, scope, t[1] AS name, t[2] AS plus, t[3] AS minus, array_to_string(t[4:], ' ') AS rest, coalesce(t[4], '') AS head FROM s3),
  s5 AS (SELECT *, regexp_extract(rest, '\bdc\b\s*=?\s*([-+0-9.]\S*)', 1) AS dcv, regexp_extract(rest, '\b(pulse|sin|exp|pwl)\b', 1) AS wave,
    list_filter(string_split(trim(replace(regexp_extract(rest, '\b(pulse|sin|exp|pwl)\s*\(?([^)]*)', 2), ',', ' ')), ' '), lambda x: x <> '') AS args FROM s4),
  s6 AS (SELECT *, CASE WHEN dcv <> '' THEN dcv WHEN regexp_matches(rest, '\bdc\b') THEN 'x' WHEN head = '' THEN '0' WHEN wave <> '' THEN coalesce(args[CASE WHEN wave = 'pwl' THEN 2 ELSE 1 END], 'x') WHEN head = 'ac' THEN '0' WHEN regexp_matches(head, '^[a-z]') THEN 'x' ELSE head END AS v0 FROM s5),
  s7 AS (SELECT *, regexp_replace(v0, ',$', '') AS v, regexp_extract(regexp_replace(v0, ',$', ''), '^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?') AS h FROM s6),
  src AS (SELECT deck_id, scope, name, plus, minus, coalesce(nullif(h, '')::DOUBLE * """ + _SC.format(s="substr(v, length(h) + 1)") + r""", 'nan'::DOUBLE) AS dc FROM s7)"""

SQL = {
    "signal_quick": """WITH v AS (SELECT vec_id AS run, unnest(range(len(embedding))) + 1.0::DOUBLE AS x, unnest(embedding)::DOUBLE * 20 AS y FROM embeddings), f AS (SELECT run, arg_min(y, x) AS first FROM v GROUP BY run),
  s AS (SELECT run, x, y, lead(y) OVER (PARTITION BY run ORDER BY x) - y AS dy FROM v)
SELECT s.run, printf('%.3e', any_value(first))::DOUBLE AS first, printf('%.3e', min(x) FILTER (y <= first - 3))::DOUBLE AS bandwidth, printf('%.3e', max(y) - min(y))::DOUBLE AS swing,
  printf('%.3e', arg_max(dy, abs(dy)))::DOUBLE AS steepest FROM s JOIN f ON f.run = s.run GROUP BY s.run""",
    "agent_search": "SELECT s_suppkey AS task, n AS name, true AS found FROM supplier, (VALUES ('l'), ('w')) t(n)",
    "agent_context": f"WITH {_CTX} SELECT task, context FROM c",
    "agent_prompts": f"""WITH {_CTX}, p AS (SELECT task, list_filter(['You are a circuit design assistant. Use the tools you are given and never invent results.', '## Task' || chr(10) || description, '## State' || chr(10) || load, context, '## History' || chr(10) || 'none'], lambda x: x IS NOT NULL AND x <> '') AS s FROM c),
  t AS (SELECT task, s, n, array_to_string(s[1:n], chr(10) || chr(10)) AS x FROM (SELECT *, unnest(range(1, len(s) + 1)) AS n FROM p))
SELECT task, md5(arg_max(x, n) FILTER (n = 1 OR greatest(1, length(x) // 4) <= 160)) AS digest FROM t GROUP BY task""",
    "agent_totals": f"WITH {_R} SELECT model, sum(greatest(1, length(coalesce(response, '')) // 4))::BIGINT AS tokens, round(coalesce(sum(CASE WHEN NOT isnan(overall) THEN round(overall, 3) END), 0), 3) AS seconds FROM r GROUP BY model",
    "agent_statuses": f"WITH {_R} SELECT CASE WHEN response IS NULL OR trim(response, ' ') = '' THEN 'skip' WHEN overall >= 0.5 THEN 'ok' ELSE 'failed' END AS status, count(*) AS n FROM r GROUP BY 1",
    "conv_first_errors": "SELECT id, array_to_string(list_transform(messages, lambda m: coalesce(m.role, '?'))[1:3], ',') AS first, len(messages)::INT AS total FROM demo_output WHERE messages IS NOT NULL",
    "score_spec_check": f"""WITH {score_plans._CTE} {score_plans._SCORED}, a AS (SELECT task_id, coalesce(sum(greatest(contract_score, 0) * weight) FILTER (actual IS NOT NULL) / nullif(sum(weight) FILTER (actual IS NOT NULL), 0), 0) AS score,
  count(actual) AS measured, count(*) - count(actual) AS unmeasurable FROM scored GROUP BY task_id) SELECT task_id, round(score, 6) AS score, measured, unmeasurable, score >= 0.95 AND unmeasurable = 0 AS success FROM a""",
    "signal_normalized_phase": """WITH v AS (SELECT vec_id AS run, unnest(range(len(embedding))) AS x, unnest(embedding)::DOUBLE * 2000 AS y FROM embeddings), f AS (SELECT run, arg_min(y, x) AS y0 FROM v GROUP BY run)
SELECT run, round(sum(y - round(y0 / 180) * 180), 4) AS total, round(any_value(y0) - round(any_value(y0) / 180) * 180, 4) AS first FROM v JOIN f USING (run) GROUP BY run""",
    "netlist_elements": f"WITH {_CARDS} SELECT deck_id, scope, letter, count(*) AS n, string_agg(name || ':' || coalesce(subckt, '-'), ',' ORDER BY name || ':' || coalesce(subckt, '-')) AS names FROM el GROUP BY deck_id, scope, letter",
    "netlist_branches": f"""WITH {_SOURCES}, one AS (SELECT deck_id, scope, name, max(dc) AS dc FROM src GROUP BY ALL), {_CARDS[_CARDS.index("c0 AS"):].replace("FROM l WHERE", "FROM l2 WHERE").join(["l2 AS (SELECT deck_id, unnest(range(len(ls))) AS line, unnest(ls) AS raw FROM (SELECT deck_id, string_split(regexp_replace(text, '\\r?\\n[ \\t]*\\+', ' ', 'g'), chr(10)) AS ls FROM k)), ", ""])},
  x AS (SELECT DISTINCT deck_id, name, subckt FROM el WHERE letter = 'x' AND scope = '')
SELECT deck_id, 'V.' || name AS branch, printf('%.6e', dc)::DOUBLE AS dc FROM one WHERE scope = ''
UNION ALL SELECT x.deck_id, 'v.' || x.name || '.vx', printf('%.6e', coalesce(one.dc, 'nan'::DOUBLE))::DOUBLE FROM x LEFT JOIN one ON one.deck_id = x.deck_id AND one.scope = x.subckt AND one.name = 'vx'""",
    "netlist_corner_decks": rf"""WITH {_D} SELECT deck_id, md5(rtrim(regexp_replace(regexp_replace(text, '(?im)^\s*\.temp\b.*\n?', '', 'g'), '(?is)\n\s*\.end\s*$', ''), ' ') || chr(10) || '.temp 125.0' || chr(10) || '.end') AS digest,
  regexp_matches(text, '(?i)\b(?:agauss|gauss|aunif|unif|limit|sgauss|sunif)\s*\(|\bmismatchflag\s*=') AS random FROM k""",
    "netlist_template_list": "SELECT id AS name FROM eval_task WHERE category = 'digital'",
    "result_corners": """WITH a AS (SELECT id, [NULL, 'ss', ' TT', 'zz'][length(id) % 4 + 1] AS corner FROM eval_task)
SELECT id, corner, CASE coalesce(lower(trim(corner)), 'tt') WHEN 'tt' THEN 'TT' WHEN 'ss' THEN 'SS' END AS section, CASE lower(trim(corner)) WHEN 'tt' THEN 1.8 WHEN 'ss' THEN 1.62 END::DOUBLE AS voltage, CASE lower(trim(corner)) WHEN 'tt' THEN 27 WHEN 'ss' THEN 125 END::DOUBLE AS temperature FROM a""",
    "result_sizing": """WITH c AS (SELECT s_suppkey AS task, c.c AS candidate, CASE WHEN c.c < 6 THEN 24 + 0.2::DOUBLE * c.c * (1 + s_suppkey % 4) END AS gain, 20.0::DOUBLE + s_suppkey % 9 AS low FROM supplier, range(1, 7) c(c)),
  s AS (SELECT *, CASE WHEN gain IS NULL THEN -1 WHEN gain >= low THEN 1 ELSE greatest(-1, log2(gain / low)) END AS score FROM c)
SELECT task, candidate::INT AS candidate, round(gain, 6) AS gain, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY task ORDER BY score DESC, candidate) = 1""",
    "result_picks": """WITH v AS (SELECT s_suppkey AS run, (s_suppkey + 1) % 3 <> 0 AS out, s_suppkey % 3 <> 0 AS net, s_suppkey % 3 <> 0 AS inp FROM supplier)
SELECT run, CASE WHEN out THEN 'V(out)' WHEN inp THEN 'in' WHEN net THEN 'v(net1)' END AS output, CASE WHEN inp THEN 'in' END AS input FROM v""",
    "result_pairs": "SELECT s_suppkey AS run, 'out' AS node, i::DOUBLE AS x, (s_suppkey + i * 1.5)::DOUBLE AS gain_db, CASE WHEN s_suppkey % 3 <> 0 THEN -1.0::DOUBLE * i END AS phase_deg FROM supplier, range(1, 6) r(i)",
    "result_axes": "SELECT s_suppkey AS run, s_suppkey % 4 <> 0 AND s_suppkey % 3 <> 0 AS same_axis FROM supplier",
    "result_provenance": f"WITH {_CARDS} SELECT DISTINCT deck_id AS run, deck_id >= '8' AS belongs FROM el WHERE letter = 'v' AND scope = ''",
    "netlist_pinned": rf"""WITH {_D} SELECT deck_id, md5(text || chr(10) || 'X9 d g s b nfet_01v8 W=1u nf=1 mult=1' || chr(10) || 'xr a b res' || chr(10) || 'X8 d g s b nfet_01v8 w=2u mult=3 nf=1') AS digest FROM k""",
    "netlist_noise_kinds": "SELECT s_suppkey, ['v', 'i', NULL][s_suppkey % 3 + 1] AS input, ['v', 'v', NULL][s_suppkey % 3 + 1] AS output FROM supplier",
    "netlist_formatted": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '-' END || (s_suppkey % 900 + 1) || ['f', 'p', 'n', 'u', 'm', '', 'k'][s_suppkey % 7 + 1] AS text FROM supplier",
    "result_scripted": """SELECT id, 5 AS n, md5(array_to_string(list_transform([['system', 'You are a circuit design assistant. Use the tools you are given and never invent results.'], ['user', category],
  ['assistant', '<tool_call>{"name":"sim.ac","arguments":{"netlist":"M1 a b c d"}}</tool_call>'], ['tool', 'gain 40'], ['assistant', 'Measured: gain 40']], lambda m: '<|im_start|>' || m[1] || chr(10) || m[2] || '<|im_end|>' || chr(10)), '')) AS digest FROM eval_task""",
    "result_bounds": "SELECT p_partkey AS part, true AS bounded, true AS jittered FROM part",
    "result_attempts": "SELECT id, unnest([1, 2, 3])::INT AS attempt FROM eval_task",
}
SQL["netlist_sources"] = f"WITH {_SOURCES} SELECT DISTINCT deck_id, scope, name, plus, minus, round(dc, 9) AS dc FROM src"
SQL["netlist_supply_current"] = f"""WITH {_SOURCES}, one AS (SELECT deck_id, scope, name, max(dc) AS dc FROM src GROUP BY ALL), a AS (SELECT deck_id, name, max(length(plus) * 0.25 - 0.5)::DOUBLE AS amps FROM src WHERE scope = '' GROUP BY ALL),
  j AS (SELECT one.*, abs(amps) AS amps FROM one JOIN a USING (deck_id, name) WHERE scope = '' AND (dc <> 0 OR isnan(dc))),
  g AS (SELECT deck_id, sum(amps) FILTER (isnan(dc) OR dc > 0) AS p, coalesce(sum(amps) FILTER (NOT isnan(dc) AND dc < 0), 0) AS n, count(*) AS used, bool_or(isnan(dc)) AS unknown FROM j GROUP BY deck_id),
  t AS (SELECT *, nullif(CASE WHEN abs(n - p) <= 0.05 * p THEN p ELSE coalesce(p, 0) + n END, 0) AS total FROM g)
SELECT deck_id, round(total, 9) AS total, used, CASE WHEN total IS NULL THEN 'zero_total' WHEN unknown THEN 'unknown_source' WHEN used > 2 THEN 'several_sources' END AS warning FROM t"""
