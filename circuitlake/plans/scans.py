"""Scans and sinks: the test tables written as files of every format and read again."""

from __future__ import annotations

from collections.abc import Iterator
from importlib.util import find_spec

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from circuitlake.operators import evaluation
from circuitlake.runtime import scratch, table
from circuitlake.sources import readers, sinks


def _chats(spark, d):
    return table(spark, d, "demo_output").select("id", "task_id", "messages", "score", "success")


def chats(spark, d):
    folder = scratch(spark)
    sinks.write_jsonl(_chats(spark, d), folder, "perturbed")
    sinks.write_jsonl(_chats(spark, d).limit(0), folder, "train_set")
    return readers.chats(spark, folder).select("id", "success", F.size("messages").alias("n"), F.substring_index("_source", "-", 1).alias("file"))


def prepared(spark, d):
    folder = scratch(spark)
    sinks.write_jsonl(_chats(spark, d), folder, "handwritten")
    sinks.write_jsonl(_chats(spark, d).filter("success"), folder, "train_set")
    return readers.first_chats(spark, folder, 25).select("id", F.size("messages").alias("n"))


def lines(spark, d):
    folder = scratch(spark)
    text = F.when(F.col("success"), F.to_json(F.struct("id", "messages"))).otherwise(F.lit("{broken"))
    rows = table(spark, d, "demo_output").select(text.alias("line"))
    sinks.write_files(rows.groupBy().agg(F.concat_ws("\n\n", F.collect_list("line")).alias("content")).select(F.lit("a.jsonl").alias("name"), "content"), folder)
    return readers.numbered_lines(spark, folder).groupBy("ok").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("line") % 2).alias("odd"))


def synonyms(spark, d):
    folder = scratch(spark)
    turn = lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value"))
    rows = table(spark, d, "demo_output").select(F.when(F.col("success"), F.col("messages")).alias("messages"), F.when(~F.col("success"), F.transform("messages", turn)).alias("conversations"))
    sinks.write_jsonl(rows, folder)
    turns = readers.chat_lines(spark, folder).select(F.explode("messages").alias("m"))
    return turns.groupBy("m.role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("m.content")).alias("chars"))


def trajectories(spark, d):
    folder = scratch(spark)
    step = F.struct(F.col("step").alias("step_index"), "role", "content", F.struct(F.col("action.name").alias("name")).alias("tool_call"))
    runs = table(spark, d, "rl_ngspice_demo").groupBy("run_id").agg(F.array_sort(F.collect_set(step)).alias("steps"), F.bool_or("done").alias("success"))
    sinks.write_jsonl(runs.select(F.col("run_id").cast("string").alias("id"), "steps", "success"), folder)
    return readers.trajectories(spark, folder).select("id", "success", F.size("steps").alias("steps"), F.size(F.filter("steps", lambda s: s["tool_call"]["name"].isNotNull())).alias("calls"))


def tasks(spark, d):
    folder = scratch(spark)
    t = table(spark, d, "eval_task")
    specs = F.transform_values("specs", lambda k, v: F.struct(*[v[c].alias(c) for c in ("min", "max", "target", "weight", "unit", "at_freq")]))
    doc = F.to_json(F.struct("id", "category", "pdk", F.when(~F.isnan("supply"), F.col("supply")).alias("supply"), "load", "description", specs.alias("specs"), "corners", "temp_range", "difficulty"))
    sinks.write_files(t.select(F.concat("category", F.lit("/"), "id", F.lit(".yaml")).alias("name"), doc.alias("content")), folder)
    got = readers.tasks(spark, folder)
    return got.select("id", "category", "pdk", "supply", "load", F.size("specs").alias("specs"), F.array_join("corners", ",").alias("corners"), F.element_at("temp_range", 1).alias("coldest"), F.col("_file").alias("file"))


def task_files(spark, d):
    folder = scratch(spark)
    t = table(spark, d, "eval_task")
    sinks.write_files(t.select(F.concat("category", F.lit("/"), "id", F.when(F.col("category") == "analog", ".YAML").otherwise(".sv")).alias("name"), F.lit("0123456789").alias("content")), folder)
    return readers.listing(spark, folder, (".yaml", ".sv", ".v"))


def reports(spark, d):
    folder = scratch(spark)
    b = table(spark, d, "benchmark").groupBy("id").agg(F.min("model").alias("model"), F.min("overall").alias("overall"))
    score = F.when(~F.isnan("overall"), F.round("overall", 6))
    rows = b.filter("model is not null").select("model", F.col("id").alias("task_id"), (score >= 0.5).alias("passed"), score.alias("final_score"), F.lit(1).alias("steps"), F.lit(None).cast("double").alias("wall_time_sec"), F.when(score.isNull(), "no score").alias("error"))
    sinks.write_run_reports(rows, folder)
    return readers.run_report(spark, folder).select("model", "task_id", "passed", "final_score", "error")


def columns(spark, d):
    folder = scratch(spark)
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).csv(folder)
    return readers.columns_csv(spark, folder).groupBy("name").agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("numbers"), F.round(F.sum("value"), 4).alias("total"))


def logs(spark, d):
    folder = scratch(spark)
    text = F.concat_ws("\n", F.lit("Start"), F.when(F.col("supply") > 1.5, "Warning: Error-prone bias"), F.when(F.col("load").isNull(), "Error: no load"), F.when(F.col("pdk").isNull(), "No convergence in DC analysis"), F.when(F.col("category") == "digital", "test FAILED"))
    sinks.write_files(table(spark, d, "eval_task").select(F.concat("id", F.lit(".log")).alias("name"), text.alias("content")), folder)
    return readers.logs(spark, folder)


def trainer(spark, d):
    folder = scratch(spark)
    b = table(spark, d, "benchmark").select("id", "model", "overall").distinct().filter("model is not null")
    entry = F.struct(F.when(~F.isnan("overall"), F.round("overall", 6)).alias("loss"), F.length("id").cast("long").alias("step"))
    docs = b.groupBy("model").agg(F.collect_list(entry).alias("log_history"))
    sinks.write_files(docs.select(F.concat("model", F.lit("/trainer_state.json")).alias("name"), F.to_json(F.struct("log_history")).alias("content")), folder)
    rows = readers.trainer_logs(spark, folder)
    return rows.groupBy(F.element_at(F.split("file", "/"), -2).alias("model"), "step").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("loss"), 4).alias("loss"))


def _raw_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Simulator files with a sweep axis, a plain vector and one complex vector in every other file."""
    for b in batches:
        out = []
        for vec, values in zip(b["vec_id"], b["embedding"], strict=True):
            y = np.asarray(values, float)
            x = np.arange(1, len(y) + 1, dtype=float)
            bent = vec % 2 == 1
            cells = np.stack([x, y], 1).astype("<c16" if bent else "<f8")
            if bent:
                cells[:, 1] += 1j
            head = f"Title: t\nFlags: {'complex' if bent else 'real'}\nNo. Variables: 2\nNo. Points: {len(y)}\nVariables:\n\t0\tfrequency\thz\n\t1\tout\tvoltage\nBinary:\n"
            out.append((f"r{vec}.raw", head.encode() + cells.tobytes()))
        yield pd.DataFrame(out, columns=["name", "content"])


def raw(spark, d):
    folder = scratch(spark)
    sinks.write_files(table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(_raw_bytes, "name string, content binary"), folder)
    got = readers.results(readers.raw_results(spark, folder))
    total = F.aggregate("samples", F.lit(0.0), lambda acc, s: acc + s["y"])
    return got.select("run", "variable", "kind", F.size("samples").alias("n"), F.round(total, 4).alias("total"))


def mock(spark, d):
    parts = [
        readers.adapter("mock")(spark, analysis=a, runs="3", points="41", corner=c).select(F.lit(a).alias("analysis"), "run", "corner", "i", F.format_string("%.5e", "y").try_cast("double").alias("y"))
        for a, c in (("ac", "tt"), ("dc", "ss"), ("tran", "ff"), ("noise", "tt"), ("mc", "tt"))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def manifest(spark, d):
    folder = scratch(spark)
    doc = sinks.manifest(table(spark, d, "corpus_source").select("id", "name", "category", "license", "license_compatible", "url", "token_count", "notes"))
    sinks.write_files(spark.createDataFrame([("manifest.json", doc)], "name string, content string"), folder)
    return readers.registry(spark, folder)


def splits(spark, d):
    folder = scratch(spark)
    rows = table(spark, d, "demo_output").select("id", F.lower(F.trim("split")).alias("split"), F.lit("x").alias("_private")).filter("split is not null")
    sinks.write_splits(rows, folder)
    back = spark.read.json(folder)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.lit(",".join(sorted(back.columns))).alias("columns"))


def report(spark, d):
    b = table(spark, d, "benchmark").filter("category is not null and difficulty is not null")
    page = evaluation.html_report(b.select("category", "difficulty", (F.coalesce("overall", F.lit(0.0)) >= 0.5).alias("passed")))
    return spark.range(1).select(F.md5(F.lit(page)).alias("digest"))


QUERIES = {
    "scan_chats": chats, "scan_prepared": prepared, "scan_lines": lines, "scan_synonyms": synonyms, "scan_trajectories": trajectories, "scan_listing": task_files,
    "scan_reports": reports, "scan_columns": columns, "scan_logs": logs, "scan_trainer": trainer, "scan_raw": raw, "scan_mock": mock, "scan_manifest": manifest,
    "sink_splits": splits, "sink_html": report,
}
if find_spec("yaml"):
    QUERIES["scan_tasks"] = tasks

_E = "printf('%.5e', {y})::DOUBLE AS y"
SQL = {
    "scan_chats": "SELECT id, success, len(messages)::INT AS n, 'perturbed' AS file FROM demo_output WHERE messages IS NOT NULL",
    "scan_prepared": "SELECT id, len(messages)::INT AS n FROM demo_output WHERE success AND messages IS NOT NULL ORDER BY id LIMIT 25",
    "scan_lines": "SELECT coalesce(success, false) AS ok, count(*) AS n, count(*) AS odd FROM demo_output GROUP BY 1",
    "scan_synonyms": "SELECT m.role AS role, count(*) AS n, sum(length(m.content))::BIGINT AS chars FROM (SELECT unnest(messages) AS m FROM demo_output) GROUP BY 1",
    "scan_trajectories": """SELECT run_id::VARCHAR AS id, bool_or(done) AS success, count(*)::INT AS steps, (count(*) FILTER (name IS NOT NULL))::INT AS calls
FROM (SELECT run_id, step, role, content, action.name AS name, bool_or(done) AS done FROM rl_ngspice_demo GROUP BY ALL) GROUP BY run_id""",
    "scan_listing": "SELECT CASE WHEN category = 'analog' THEN '.yaml' ELSE '.sv' END AS suffix, count(*) AS files, (count(*) * 10)::BIGINT AS bytes FROM eval_task GROUP BY 1",
    "scan_reports": """WITH b AS (SELECT id, min(model) AS model, min(overall) AS overall FROM benchmark GROUP BY id), s AS (SELECT *, CASE WHEN NOT isnan(overall) THEN round(overall, 6) END AS s FROM b WHERE model IS NOT NULL)
SELECT model, id AS task_id, s >= 0.5 AS passed, s AS final_score, CASE WHEN s IS NULL THEN 'no score' END AS error FROM s""",
    "scan_columns": """SELECT 's_suppkey' AS name, count(*) AS cells, count(*) AS numbers, round(sum(s_suppkey)::DOUBLE, 4) AS total FROM supplier
UNION ALL SELECT 's_name', count(*), 0, NULL FROM supplier UNION ALL SELECT 's_acctbal', count(*), count(s_acctbal), round(sum(s_acctbal), 4) FROM supplier""",
    "scan_logs": """SELECT id || '.log' AS file, pdk IS NOT NULL AS converged, (supply > 1.5)::BIGINT AS warnings, (load IS NULL)::BIGINT AS errors, category = 'digital' AS failed
FROM (SELECT id, pdk, load, category, coalesce(supply, 0) AS supply FROM eval_task)""",
    "scan_trainer": """SELECT model, length(id)::BIGINT AS step, count(*) AS n, round(sum(round(overall, 6)), 4) AS loss FROM (SELECT DISTINCT id, model, overall FROM benchmark)
WHERE model IS NOT NULL AND overall IS NOT NULL AND NOT isnan(overall) GROUP BY ALL""",
    "scan_raw": """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS y FROM embeddings)
SELECT 'r' || vec_id AS run, 'out' AS variable, 'sweep' AS kind, count(*)::INT AS n, round(sum(y), 4) AS total FROM v WHERE vec_id % 2 = 0 GROUP BY vec_id
UNION ALL SELECT 'r' || vec_id, 'vdb(out)', 'sweep', count(*)::INT, round(sum(20 * log10(sqrt(y * y + 1))), 4) FROM v WHERE vec_id % 2 = 1 GROUP BY vec_id
UNION ALL SELECT 'r' || vec_id, 'vp(out)', 'sweep', count(*)::INT, round(sum(degrees(atan2(1, y))), 4) FROM v WHERE vec_id % 2 = 1 GROUP BY vec_id""",
    "scan_mock": f"""WITH g AS (SELECT r.run, i.i::INT AS i, i.i::DOUBLE AS k FROM range(3) r(run), range(41) i(i))
SELECT 'ac' AS analysis, run, 'tt' AS corner, i, {_E.format(y="40 + run - 10 * log10(1 + pow(pow(10, k * 8 / 40) / 1e4, 2))")} FROM g
UNION ALL SELECT 'dc', run, 'ss', i, {_E.format(y="0.8::DOUBLE * (1.8::DOUBLE / (1 + exp((k * 1.8::DOUBLE / 40 - 0.9::DOUBLE) * (10 + run))))")} FROM g
UNION ALL SELECT 'tran', run, 'ff', i, {_E.format(y="1.2::DOUBLE * (1 - exp(-(k * 1e-6 / 40) * (5e6 + 1e6 * run)))")} FROM g
UNION ALL SELECT 'noise', run, 'tt', i, {_E.format(y="(10 + run) * sqrt(1 + 1e3 / pow(10, 1 + k * 5 / 40))")} FROM g
UNION ALL SELECT 'mc', run, 'tt', i, {_E.format(y="1.2::DOUBLE + 0.01::DOUBLE * (k * 0.6180339887498949::DOUBLE - floor(k * 0.6180339887498949::DOUBLE) - 0.5::DOUBLE) + 0.001::DOUBLE * run")} FROM g""",
    "scan_manifest": "SELECT id, name, category, license, license_compatible, url, token_count, notes FROM corpus_source",
    "sink_splits": "SELECT lower(trim(split)) AS split, count(*) AS n, 'id,split' AS columns FROM demo_output WHERE split IS NOT NULL GROUP BY 1",
    "sink_html": """WITH g AS (SELECT category, difficulty, count(*) AS n, count(*) FILTER (coalesce(overall, 0) >= 0.5) * 100 // count(*) AS pct FROM benchmark WHERE category IS NOT NULL AND difficulty IS NOT NULL GROUP BY ALL)
SELECT md5('<table>' || string_agg('<tr><td>' || category || '</td><td>' || difficulty || '</td><td>' || n || '</td><td>' || pct || '%</td><td><div style="width:' || pct || 'px"></div></td></tr>', '' ORDER BY category, difficulty) || '</table>') AS digest FROM g""",
}
if find_spec("yaml"):
    SQL["scan_tasks"] = """SELECT id, category, pdk, CASE WHEN NOT isnan(supply) THEN supply END AS supply, load, cardinality(specs)::INT AS specs, array_to_string(corners, ',') AS corners, temp_range[1] AS coldest, id || '.yaml' AS file FROM eval_task"""
