"""Corpus preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlake.operators import corpus
from circuitlake.runtime import table


def _docs(spark, d):
    return table(spark, d, "documents")


def dedup(spark, d):
    return corpus.dedup_text(_docs(spark, d)).select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))


def quality(spark, d):
    return corpus.quality(_docs(spark, d)).select("doc_id", F.length("text").alias("chars"))


def split(spark, d):
    return corpus.stratified_split(_docs(spark, d).select("doc_id", "source"), "source", F.col("doc_id")).select("doc_id", "source", "split")


def hash_split(spark, d):
    return corpus.hash_split(_docs(spark, d).select("doc_id"), F.col("doc_id")).select("doc_id", "split")


def dedup_ids(spark, d):
    rows = table(spark, d, "demo_output")
    return corpus.dedup_by_id(rows, "id", [F.col("ingested_at")], ["task_id", "source", "ingested_at"])


def difficulty(spark, d):
    rows = corpus.dedup_by_id(table(spark, d, "demo_output"), "id", [F.col("ingested_at")], ["messages", "score", "source"])
    return rows.select("id", F.round(corpus.difficulty(), 6).alias("difficulty"))


def curriculum(spark, d):
    """Position of every training record in the curriculum, ranked within hash-free difficulty bands."""
    rows = corpus.dedup_by_id(table(spark, d, "demo_output"), "id", [F.col("ingested_at")], ["messages", "score", "source", "split"])
    rows = rows.filter(F.lower(F.trim("split")) == "train")
    return corpus.curriculum(rows).select("id", "source", F.round("difficulty", 6).alias("difficulty"))


def mix(spark, d):
    c = _docs(spark, d).filter("source like 'repo%'").select("doc_id", "source")
    f = _docs(spark, d).filter("source not like 'repo%'").select("doc_id", "source")
    return corpus.mix(c, f, 0.3, "doc_id").select("doc_id", "origin")


def _token_lists(spark, d):
    b = table(spark, d, "benchmark")
    lists = []
    for column in ("category", "difficulty", "model"):
        lists.append(b.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("token")).agg(F.min("id").alias("pos")))
    lists.append(table(spark, d, "eval_task").filter("category is not null").groupBy(F.col("category").alias("token")).agg(F.min("id").alias("pos")))
    return lists


def vocabulary(spark, d):
    return corpus.ordered_union(_token_lists(spark, d)).select("token", "list", "pos")


def vocabulary_new(spark, d):
    known = table(spark, d, "corpus_source").select(F.col("category").alias("token")).union(table(spark, d, "eval_task").select("category"))
    return corpus.new_tokens(corpus.ordered_union(_token_lists(spark, d)), known).select("token")


def source_union(spark, d):
    """Bag union of tables with different columns."""
    a = table(spark, d, "demo_output").select("id", "source", "score")
    b = table(spark, d, "benchmark").select("id", F.col("overall").alias("score"), "model")
    return a.unionByName(b, allowMissingColumns=True)


QUERIES = {
    "corpus_prepare": lambda spark, d: corpus.prepare(_docs(spark, d)),
    "corpus_dedup_text": dedup,
    "corpus_dedup_id": dedup_ids,
    "corpus_quality": quality,
    "corpus_licenses": lambda spark, d: corpus.license_messages(table(spark, d, "corpus_source")),
    "corpus_source_summary": lambda spark, d: corpus.source_summary(table(spark, d, "corpus_source")),
    "corpus_stratified_split": split,
    "corpus_hash_split": hash_split,
    "corpus_difficulty": difficulty,
    "corpus_curriculum": curriculum,
    "corpus_mix": mix,
    "corpus_vocabulary": vocabulary,
    "corpus_vocabulary_new": vocabulary_new,
    "corpus_source_union": source_union,
    "corpus_collection_totals": lambda spark, d: corpus.collection_totals(_docs(spark, d)),
}

_KEPT = """
  first AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY coalesce(md5(text), 'null')),
  kept AS (SELECT d.* FROM documents d SEMI JOIN first USING (doc_id)
           WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 10 AND NOT contains(text, chr(65533)))
"""
_FIRST = "f AS (SELECT * FROM demo_output QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
_DIFF = """round(least(1.0::DOUBLE, coalesce(len(messages), 0) / 20.0::DOUBLE) * 0.3 + least(1.0::DOUBLE, coalesce(len(list_distinct(flatten(list_transform(
    list_filter(list_transform(messages, lambda m: coalesce(m.content, '')), lambda t: contains(t, 'tool_call')),
    lambda t: regexp_extract_all(t, '"name"\\s*:\\s*"([^"]+)"', 1))))), 0) / 6.0::DOUBLE) * 0.4 + (1.0::DOUBLE - coalesce(score, 0.5)) * 0.3, 6)"""
_LISTS = """
  lists AS (
    SELECT 0 AS list, category AS token, min(id) AS pos FROM benchmark WHERE category IS NOT NULL GROUP BY 2
    UNION ALL SELECT 1, difficulty, min(id) FROM benchmark WHERE difficulty IS NOT NULL GROUP BY 2
    UNION ALL SELECT 2, model, min(id) FROM benchmark WHERE model IS NOT NULL GROUP BY 2
    UNION ALL SELECT 3, category, min(id) FROM eval_task WHERE category IS NOT NULL GROUP BY 2)
"""

SQL = {
    "corpus_prepare": f"""WITH {_KEPT},
  r AS (SELECT source, length(text) AS chars, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM kept)
SELECT source, CASE WHEN rn <= round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split, count(*) AS documents, sum(chars // 4)::BIGINT AS tokens FROM r GROUP BY ALL""",
    "corpus_dedup_text": "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, md5(any_value(text)) AS digest FROM documents GROUP BY coalesce(md5(text), 'null')",
    "corpus_dedup_id": f"WITH {_FIRST} SELECT id, task_id, source, ingested_at FROM f",
    "corpus_quality": "SELECT doc_id, length(text) AS chars FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 10 AND NOT contains(text, chr(65533))",
    "corpus_licenses": "SELECT id, 'source ' || id || ' has incompatible license ' || coalesce(license, '?') AS message FROM corpus_source WHERE NOT license_compatible",
    "corpus_source_summary": "SELECT category, license, sum(coalesce(token_count, 0))::BIGINT AS tokens, count(*) AS sources FROM corpus_source GROUP BY GROUPING SETS ((category), (license), ())",
    "corpus_stratified_split": """SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id)
  <= round_even(count(*) OVER (PARTITION BY source) * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM documents""",
    "corpus_hash_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'test' END AS split FROM documents",
    "corpus_difficulty": f"WITH {_FIRST} SELECT id, {_DIFF} AS difficulty FROM f",
    "corpus_curriculum": f"WITH {_FIRST} SELECT id, source, {_DIFF} AS difficulty FROM f WHERE lower(trim(split)) = 'train' ORDER BY difficulty, source, id",
    "corpus_mix": """WITH c AS (SELECT doc_id FROM documents WHERE source LIKE 'repo%'), n AS (SELECT floor(count(*) * 0.3 / 0.7)::BIGINT AS k FROM c),
  f AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents WHERE source NOT LIKE 'repo%')
SELECT doc_id, 'corpus' AS origin FROM c UNION ALL SELECT doc_id, 'filler' FROM f, n WHERE rn <= k""",
    "corpus_vocabulary": f"WITH {_LISTS} SELECT token, list, pos FROM lists QUALIFY row_number() OVER (PARTITION BY token ORDER BY list, pos) = 1",
    "corpus_vocabulary_new": f"WITH {_LISTS} SELECT DISTINCT token FROM lists WHERE token NOT IN (SELECT category FROM corpus_source WHERE category IS NOT NULL UNION SELECT category FROM eval_task WHERE category IS NOT NULL)",
    "corpus_source_union": "SELECT id, source, score, NULL::VARCHAR AS model FROM demo_output UNION ALL SELECT id, NULL, overall, model FROM benchmark",
    "corpus_collection_totals": "SELECT source, count(*) AS files, sum(coalesce(strlen(text), 0))::BIGINT AS bytes, sum(coalesce(strlen(text), 0) // 4)::BIGINT AS tokens, grouping(source) AS is_total FROM documents GROUP BY ROLLUP(source)",
}
