"""Queries of the training-data operators over whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from circuitlake.llm import abuse, brokenpairs, crosssplit, leaks, neardup, packing, repeats, splits
from circuitlake.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, n) for n in names))


QUERIES: dict[str, Query] = {
    "p1_found": _over(splits.found, "demo_output", "eval_task", "task_alias"),
    "p1_splits": _over(lambda *t: splits.assign(*t).select("id", "component", "split"), "demo_output", "eval_task", "task_alias"),
    "p1_report": _over(lambda *t: splits.report(splits.assign(*t)), "demo_output", "eval_task", "task_alias"),
    "p1_whole": _over(lambda *t: splits.whole(splits.assign(*t)), "demo_output", "eval_task", "task_alias"),
    "p2_found": _over(
        lambda t: repeats.repeated_actions(t).filter("n_events >= 2").select("run_id", "first_step", "last_step"), "rl_ngspice_demo"
    ),
    "p2_names": _over(repeats.repeated_names, "rl_ngspice_demo"),
    "p2_events": _over(repeats.repeated_actions, "rl_ngspice_demo"),
    "p3_found": _over(brokenpairs.found, "benchmark"),
    "p3_posteriors": _over(brokenpairs.of_benchmark, "benchmark"),
    "p5_found": _over(crosssplit.found, "demo_output"),
    "p5_report": _over(crosssplit.report, "demo_output"),
    "p5_fractions": _over(crosssplit.fractions, "demo_output"),
    "p6_found": _over(neardup.found, "demo_output"),
    "p6_groups": _over(neardup.groups, "demo_output"),
    "p7_sequences": _over(packing.pack_documents, "documents"),
    "p7_report": _over(lambda t: packing.report(packing.packed_items(t)), "documents"),
    "p7_whole": _over(lambda t: packing.whole(packing.pack_documents(t)), "documents"),
    "p8_found": _over(leaks.found, "documents", "eval_task"),
    "p8_report": _over(leaks.report, "documents", "eval_task"),
    "p8_sources": _over(leaks.sources, "documents", "eval_task"),
    "p9_found": _over(abuse.found, "documents", "labels"),
    "p9_scores": _over(abuse.scored, "documents", "labels"),
    "p9_whole": _over(abuse.whole, "documents", "labels"),
    "p9_rates": _over(abuse.rates, "documents", "labels"),
}

_FOLD = r"""
  CASE WHEN {x} IS NULL THEN NULL ELSE
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    lower(regexp_replace({x}, '^\s+|\s+$', '', 'g')),
    '^.*[/\\]', ''), '\s*[#@].*$', ''), '[\s_.\-]*\(?\b(?:rev|run|v|version|revision)[\s_.\-]*\d+\)?$', ''),
    '\.(?:ya?ml|json|cir|sp|txt)$', ''), '[^\p{{L}}\p{{Nd}}]+', '_', 'g'), '^_+|_+$', '', 'g'), '^$', '') END
"""


def _key(x: str) -> str:
    s = _FOLD.format(x=x)
    return f"(SELECT CASE WHEN length(s) > 0 THEN replace(regexp_replace(s, '\\d+$', ''), '_', '') || '#' || regexp_replace(regexp_extract(s, '(\\d+)$', 1), '^0+(\\d)', '\\1') END FROM (SELECT {s} AS s))"


_WORDS = """
  bags AS (
    SELECT id, any_value(lower(trim(split))) AS split,
           regexp_extract_all(lower(list_aggregate(list_transform(list_filter(any_value(messages),
             lambda m: coalesce(lower(trim(m.role)), '') <> 'system' AND m.content IS NOT NULL), lambda m: m.content), 'string_agg', chr(10))), '[\\p{L}\\p{N}]+') AS ws
    FROM demo_output WHERE id IS NOT NULL GROUP BY id),
  sizes AS (SELECT id, split, len(ws) AS n FROM bags WHERE len(ws) > 0),
  tokens AS (
    SELECT id, w, row_number() OVER (PARTITION BY id, w) AS k FROM (SELECT id, unnest(ws) AS w FROM bags)),
  shared AS (
    SELECT a.id AS id_a, b.id AS id_b, count(*) AS c
    FROM tokens a JOIN tokens b ON a.w = b.w AND a.k = b.k AND a.id < b.id GROUP BY 1, 2),
  near AS (
    SELECT id_a, id_b, x.split AS sa, y.split AS sb
    FROM shared JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE c >= 0.8 * (x.n + y.n - c))
"""

SQL: dict[str, str] = {
    "p1_found": f"""
WITH RECURSIVE
  tasks AS (SELECT {_key("id")} AS k, min(id) AS task FROM eval_task WHERE id IS NOT NULL GROUP BY 1),
  links AS (SELECT {_key("old_id")} AS k, min({_key("new_id")}) AS t FROM task_alias GROUP BY 1),
  ends AS (SELECT k, t FROM links UNION SELECT e.k, l.t FROM ends e JOIN links l ON l.k = e.t),
  names AS (
    SELECT k, task FROM tasks
    UNION ALL SELECT e.k, min(task) FROM ends e JOIN tasks ON tasks.k = e.t WHERE e.k NOT IN (SELECT k FROM tasks) GROUP BY 1)
SELECT id, min(task) AS task_id
FROM (SELECT id, {_key("task_id")} AS k FROM demo_output WHERE id IS NOT NULL) r JOIN names USING (k) GROUP BY id
""",
    "p5_found": f"""
WITH {_WORDS}
SELECT id_a, id_b FROM near
WHERE (sa = 'train' AND sb IN ('val', 'test')) OR (sb = 'train' AND sa IN ('val', 'test'))
""",
    "p6_found": f"""
WITH RECURSIVE {_WORDS},
  edges AS (SELECT id_a AS u, id_b AS v FROM near UNION ALL SELECT id_b, id_a FROM near),
  reach AS (SELECT DISTINCT u AS a, u AS b FROM edges UNION SELECT reach.a, edges.v FROM reach JOIN edges ON edges.u = reach.b)
SELECT min(b) AS group_id, a AS id FROM reach GROUP BY a
""",
    "p1_whole": "SELECT count(DISTINCT id) AS records, 0 AS torn, true AS near_train, true AS near_val, true AS near_test FROM demo_output WHERE id IS NOT NULL",
    "p2_names": """
WITH s AS (SELECT run_id, step::BIGINT AS step, action.name AS name, ts FROM rl_ngspice_demo WHERE run_id IS NOT NULL AND step IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY run_id, step ORDER BY received_at IS NULL, received_at) = 1),
  m AS (SELECT *, CASE WHEN name IS NOT DISTINCT FROM lag(name) OVER w AND name IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY run_id ORDER BY step)),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT run_id, min(step) AS first_step, max(step) AS last_step, name AS action, count(*) AS n_events, (epoch_us(list(ts ORDER BY step)[-1]) - epoch_us(list(ts ORDER BY step)[1])) / 1e6 AS duration_s
FROM (SELECT run_id, g, name, step, ts FROM g WHERE name IS NOT NULL) GROUP BY run_id, g, name
""",
    "p5_report": f"""
WITH {_WORDS},
  src AS (SELECT id, any_value(source) AS source FROM demo_output GROUP BY id),
  l AS (SELECT CASE WHEN sa = 'train' THEN id_a ELSE id_b END AS t, CASE WHEN sa = 'train' THEN id_b ELSE id_a END AS e, CASE WHEN sa = 'train' THEN sb ELSE sa END AS eval_split
        FROM near WHERE (sa = 'train' AND sb IN ('val', 'test')) OR (sb = 'train' AND sa IN ('val', 'test')))
SELECT eval_split, source AS source_eval, count(*) AS pairs, count(DISTINCT e) AS eval_records, count(DISTINCT t) AS train_records FROM l JOIN src ON src.id = l.e GROUP BY ALL
""",
    "p6_groups": f"""
WITH RECURSIVE {_WORDS},
  edges AS (SELECT id_a AS u, id_b AS v FROM near UNION ALL SELECT id_b, id_a FROM near),
  reach AS (SELECT DISTINCT u AS a, u AS b FROM edges UNION SELECT reach.a, edges.v FROM reach JOIN edges ON edges.u = reach.b),
  content AS (SELECT id, md5(array_to_string(list_sort(ws), ' ')) AS c FROM bags),
  n AS (SELECT u AS id, count(DISTINCT y.c) FILTER (y.c <> x.c) AS n_links FROM edges JOIN content x ON x.id = u JOIN content y ON y.id = v GROUP BY u)
SELECT min(b) AS group_id, a AS id, any_value(n_links) AS n_links FROM reach JOIN n ON n.id = a GROUP BY a
""",
    "p7_whole": r"SELECT count(DISTINCT doc_id) AS documents, 0 AS late, 0 AS gap, 0 AS split, 0 AS overfull FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '\S')",
    "p9_whole": "SELECT source, count(DISTINCT doc_id) AS documents, 0 AS odd FROM documents WHERE doc_id IS NOT NULL GROUP BY source",
    "p8_found": r"""
WITH
  docs AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
  runs AS (SELECT doc_id, array_to_string(ws[i:i+11], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM docs WHERE len(ws) >= 12)),
  tests AS (SELECT id, regexp_extract_all(lower(description), '[\p{L}\p{N}]+') AS ws FROM eval_task WHERE description IS NOT NULL),
  keys AS (SELECT id, array_to_string(ws[i:i+11], ' ') AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 10)) AS i FROM tests WHERE len(ws) >= 12))
SELECT DISTINCT doc_id, id AS task_id FROM runs JOIN keys USING (g)
""",
}
SQL["p8_sources"] = f"SELECT source, count(DISTINCT f.doc_id) AS leaked FROM documents d LEFT JOIN ({SQL['p8_found']}) f ON f.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL GROUP BY source"
