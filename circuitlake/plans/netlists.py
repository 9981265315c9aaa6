"""Deck queries over all netlists of rl_ngspice_demo that are deck text."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlake.operators import netlists as net
from circuitlake.runtime import table


def _decks(spark, d):
    """Distinct deck texts; the id is the text's digest."""
    rows = table(spark, d, "rl_ngspice_demo").select(F.col("action.arguments.netlist").alias("text")).filter("contains(text, '\\n')")
    return rows.distinct().select(F.md5(F.col("text").cast("binary")).alias("deck_id"), "text")


def instances(spark, d):
    i = net.instances(_decks(spark, d))
    params = F.array_join(F.transform("params", lambda p: F.concat(p["k"], F.lit("="), p["v"])), ",")
    return i.select("deck_id", "line", "name", F.array_join("nodes", ",").alias("nodes"), "model", params.alias("params"))


def values(spark, d):
    i = net.instances(_decks(spark, d)).select("deck_id", "line", F.explode("params").alias("p"))
    strict, loose = net.strict_number(F.col("p.v")), net.loose_number(F.col("p.v"))
    return i.select("deck_id", "line", F.col("p.k").alias("name"), F.format_string("%.6e", strict).try_cast("double").alias("strict"), F.format_string("%.6e", loose).try_cast("double").alias("loose"))


def patched(spark, d):
    ops = F.array(
        *[F.struct(F.lit(a).alias("op"), F.lit(b).alias("target"), F.lit(c).alias("value"))
          for a, b, c in (("add_instance", "", "R99 out 0 1k"), ("remove_instance", "C1", ""), ("modify_param", "M1", "AD=1p"), ("add_net", "x", "y"))]
    )
    return _decks(spark, d).select("deck_id", F.md5(net.patch(F.col("text"), ops)).alias("digest"))


def supplies(spark, d):
    return _decks(spark, d).select("deck_id", F.md5(net.set_supply(F.col("text"), 1.5)["text"]).alias("digest"), net.set_supply(F.col("text"), 1.5)["changed"].alias("changed"))


def parameters(spark, d):
    line = F.col("raw")
    found = net.find_lines(_decks(spark, d), "^[Mm]\\d")
    return found.select("deck_id", "line", net.set_parameter(line, "W", F.lit("9u")).alias("w"), net.set_parameter(line, "NF", F.lit("2")).alias("nf"))


def sources(spark, d):
    s = net.sources(_decks(spark, d))
    return s.select("deck_id", "scope", "name", "plus", "minus", F.round("dc", 9).alias("dc")).distinct()


def supply_totals(spark, d):
    decks = _decks(spark, d)
    s = net.sources(decks)
    amps = s.filter("scope = ''").groupBy("deck_id", "name").agg(F.max(F.length("plus") * 0.25 - 0.5).alias("amps"))
    one = s.groupBy("deck_id", "scope", "name").agg(F.max("dc").alias("dc"))
    t = net.supply_current(amps, one)
    return t.select("deck_id", F.round("total", 9).alias("total"), "used", "warning")


def paths(spark, d):
    rows = table(spark, d, "rl_ngspice_demo").select(F.col("action.arguments.netlist").alias("p")).filter("p is not null and not contains(p, '\\n')").distinct()
    return rows.select(F.col("p").alias("path"), net.shared_path(F.col("p")).alias("shared"))


def templates(spark, d):
    t = table(spark, d, "eval_task").select("id", F.concat(F.lit("{name} at {supply} V, {load}; {name}"), F.lit("")).alias("tpl"), "load", "supply")
    v = F.map_concat(
        F.create_map(F.lit("name"), F.col("id"), F.lit("supply"), F.coalesce(F.format_number("supply", 1), F.lit("?"))),
        F.when(F.col("load").isNotNull(), F.create_map(F.lit("load"), F.col("load"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))),
    )
    return t.select("id", F.array_join(net.placeholders(F.col("tpl")), ",").alias("names"), net.fill(F.col("tpl"), v).alias("text"))


QUERIES = {
    "netlist_instances": instances,
    "netlist_values": values,
    "netlist_lint": lambda spark, d: net.lint(_decks(spark, d).union(_decks(spark, d).select("deck_id", F.concat("text", F.lit("\nM1 a b 0 0 nch")))).groupBy("deck_id").agg(F.max("text").alias("text"))),
    "netlist_patched": patched,
    "netlist_set_supply": supplies,
    "netlist_set_parameter": parameters,
    "netlist_sources": sources,
    "netlist_supply_current": supply_totals,
    "netlist_paths": paths,
    "netlist_templates": templates,
    "netlist_perturbed": lambda spark, d: net.perturbed(_decks(spark, d), [*net.PERTURBATIONS, "swap_models"], 2).select("deck_id", "applied", F.md5("text").alias("digest")),
}

_D = "d AS (SELECT DISTINCT action.arguments.netlist AS text FROM rl_ngspice_demo WHERE contains(action.arguments.netlist, chr(10))), k AS (SELECT md5(text) AS deck_id, text FROM d)"
_L = f"{_D}, l AS (SELECT deck_id, unnest(range(len(ls))) AS line, unnest(ls) AS raw FROM (SELECT deck_id, string_split(text, chr(10)) AS ls FROM k))"
_I = f"""{_L}, t AS (SELECT deck_id, line, list_filter(string_split(trim(regexp_replace(raw, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM l),
  u AS (SELECT *, coalesce(nullif(list_position(list_transform(t, lambda x: contains(x, '=')), true), 0), len(t) + 1) AS f FROM t WHERE len(t) > 0 AND NOT regexp_matches(t[1], '^[*.+;$]')),
  i AS (SELECT deck_id, line, t[1] AS name, t[2:f - 1] AS plain, list_filter(t[f:], lambda x: contains(x, '=')) AS ps FROM u)"""
_NUM = "regexp_extract(lower(v), '^([+-]?\\d*\\.?\\d+(?:e[+-]?\\d+)?)([a-z]*)$', {g})"
_SC = "CASE WHEN {s} LIKE 'meg%' THEN 1e6 WHEN {s} LIKE 'mil%' THEN 25.4e-6 WHEN {s} LIKE 't%' THEN 1e12 WHEN {s} LIKE 'g%' THEN 1e9 WHEN {s} LIKE 'k%' THEN 1e3 WHEN {s} LIKE 'm%' THEN 1e-3 WHEN {s} LIKE 'u%' THEN 1e-6 WHEN {s} LIKE 'n%' THEN 1e-9 WHEN {s} LIKE 'p%' THEN 1e-12 WHEN {s} LIKE 'f%' THEN 1e-15 ELSE 1 END"
_SX = "CASE {s} WHEN 'meg' THEN 1e6 WHEN 't' THEN 1e12 WHEN 'g' THEN 1e9 WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e-3 WHEN 'u' THEN 1e-6 WHEN 'n' THEN 1e-9 WHEN 'p' THEN 1e-12 WHEN 'f' THEN 1e-15 WHEN 'x' THEN 1e6 WHEN 'a' THEN 1e-18 ELSE 1 END"
_JOIN = "string_agg({x}, chr(10) ORDER BY line)"

SQL = {
    "netlist_instances": f"WITH {_I} SELECT deck_id, line, name, array_to_string(plain[1:len(plain) - 1], ',') AS nodes, plain[-1] AS model, array_to_string(ps, ',') AS params FROM i",
    "netlist_values": f"""WITH {_I}, p AS (SELECT deck_id, line, unnest(ps) AS p FROM i), q AS (SELECT deck_id, line, split_part(p, '=', 1) AS name, substr(p, strpos(p, '=') + 1) AS v FROM p),
  r AS (SELECT *, {_NUM.format(g=1)} AS n, {_NUM.format(g=2)} AS s, regexp_extract(lower(v), '^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:e[+-]?\\d+)?') AS h FROM q)
SELECT deck_id, line, name, printf('%.6e', coalesce(nullif(n, '')::DOUBLE * {_SX.format(s="s")}, 0))::DOUBLE AS strict,
  printf('%.6e', coalesce(nullif(h, '')::DOUBLE * {_SC.format(s="substr(lower(v), length(h) + 1)")}, 'nan'::DOUBLE))::DOUBLE AS loose FROM r""",
    "netlist_lint": f"""WITH {_D}, k2 AS (SELECT deck_id, max(text) AS text FROM (SELECT * FROM k UNION ALL SELECT deck_id, text || chr(10) || 'M1 a b 0 0 nch' FROM k) GROUP BY 1),
  l AS (SELECT deck_id, unnest(range(1, len(ls) + 1)) AS line, regexp_replace(unnest(ls), '^\\s+|\\s+$', '', 'g') AS raw FROM (SELECT deck_id, string_split(text, chr(10)) AS ls FROM k2)),
  n AS (SELECT deck_id, line, string_split(regexp_replace(raw, '\\s+', ' ', 'g'), ' ')[1] AS name FROM l WHERE raw <> '' AND NOT regexp_matches(raw, '^[*.]'))
SELECT deck_id, line, name FROM n QUALIFY row_number() OVER (PARTITION BY deck_id, name ORDER BY line) > 1""",
    "netlist_patched": f"""WITH {_L}, a AS (SELECT deck_id, line, raw FROM l WHERE NOT starts_with(trim(raw), 'C1') UNION ALL SELECT deck_id, 1000000, 'R99 out 0 1k' FROM k)
SELECT deck_id, md5({_JOIN.format(x="CASE WHEN starts_with(trim(raw), 'M1') THEN raw || ' AD=1p' ELSE raw END")}) AS digest FROM a GROUP BY 1""",
    "netlist_set_supply": f"""WITH {_L}, h AS (SELECT *, '^(\\s*v\\S*\\s+(?:vdd|vcc|vdda|vddd|avdd|dvdd|vpwr|vsup)\\s+(?:0|gnd|gnd!|vss|vgnd)\\s+)' AS h FROM l),
  r AS (SELECT deck_id, line, raw, regexp_replace(raw, h || '(?:dc\\s*=?\\s*)?[-+0-9.]\\S*(.*)$', '\\1DC 1.5\\2', 'i') AS a, regexp_replace(raw, h || '((?:ac|pulse|sin|pwl|exp)\\b.*)$', '\\1DC 1.5 \\2', 'i') AS b,
    regexp_matches(raw, h || '(?:dc\\s*=?\\s*)?[-+0-9.]\\S*(.*)$', 'i') AS p, regexp_matches(raw, h || '((?:ac|pulse|sin|pwl|exp)\\b.*)$', 'i') AS w FROM h)
SELECT deck_id, md5({_JOIN.format(x="CASE WHEN p THEN a WHEN w THEN b ELSE raw END")}) AS digest, count(*) FILTER (p OR w)::INT AS changed FROM r GROUP BY 1""",
    "netlist_set_parameter": f"""WITH {_L} SELECT deck_id, line, CASE WHEN regexp_matches(raw, '(^|\\s)W\\s*=\\s*\\S+') THEN regexp_replace(raw, '(^|\\s)W\\s*=\\s*\\S+', '\\1W=9u', 'g') ELSE raw || ' W=9u' END AS w,
  CASE WHEN regexp_matches(raw, '(^|\\s)NF\\s*=\\s*\\S+') THEN regexp_replace(raw, '(^|\\s)NF\\s*=\\s*\\S+', '\\1NF=2', 'g') ELSE raw || ' NF=2' END AS nf FROM l WHERE NOT starts_with(trim(raw), '*') AND regexp_matches(raw, '^[Mm]\\d')""",
    "netlist_paths": """WITH p AS (SELECT DISTINCT action.arguments.netlist AS path FROM rl_ngspice_demo WHERE action.arguments.netlist IS NOT NULL AND NOT contains(action.arguments.netlist, chr(10))), q AS (SELECT path, replace(path, '\\', '/') AS p FROM p)
SELECT path, CASE WHEN regexp_matches(p, '^[A-Za-z]:/') THEN '/mnt/' || lower(p[1]) || '/' || regexp_replace(p, '^[A-Za-z]:/+', '') ELSE p END AS shared FROM q""",
    "netlist_templates": "SELECT id, 'name,supply,load' AS names, CASE WHEN load IS NOT NULL THEN id || ' at ' || coalesce(CASE WHEN NOT isnan(supply) THEN printf('%.1f', supply) END, '?') || ' V, ' || load || '; ' || id END AS text FROM eval_task",
}
