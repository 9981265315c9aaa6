"""Writers: JSON lines, split files, manifests and JSON-safe values."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from circuitlake.functions.mathx import is_finite, significant


def _folder(path: str):
    """(file system, folder) of a path or URI, created if need be."""
    from pyarrow import fs

    where, folder = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(path)
    where.create_dir(folder, recursive=True)
    return where, folder


def write_jsonl(df: DataFrame, path: str, name: str = "part") -> int:
    """One JSON document per line in files name-00000.jsonl and so on, written in parallel, one
    per partition; a repeated task writes the same file again. Returns the number of lines."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = _folder(path)
        n = 0
        with where.open_output_stream(f"{folder}/{name}-{TaskContext.get().partitionId():05d}.jsonl") as out:
            for b in batches:
                for line in b.column(0).to_pylist():
                    out.write(line.encode() + b"\n")
                    n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows = df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(write, "n long")
    return rows.agg(F.sum("n")).first()[0] or 0


def write_files(df: DataFrame, path: str) -> int:
    """One file per row (name, content), written in parallel; returns their number."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = _folder(path)
        n = 0
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where.create_dir(f"{folder}/{name}".rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows = df.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(write, "n long")
    return rows.agg(F.sum("n")).first()[0] or 0


def write_run_reports(results: DataFrame, path: str) -> int:
    """One report {model, passed, errors, results: [...]} per model of results (model, task_id,
    passed, final_score, steps, wall_time_sec, error); a report is one document, so the results of
    one run must fit in one row."""
    row = F.struct("task_id", "passed", "final_score", "steps", "wall_time_sec", "error")
    docs = results.groupBy("model").agg(F.count_if("passed").alias("passed"), F.count("error").alias("errors"), F.array_sort(F.collect_list(row)).alias("results"))
    return write_files(docs.select(F.concat(F.col("model"), F.lit(".json")).alias("name"), F.to_json(F.struct("*")).alias("content")), path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder of JSON lines per split; columns that start with an underscore are private."""
    public = df.drop(*[c for c in df.columns if c.startswith("_")])
    public.write.mode("overwrite").partitionBy(split).json(path)


def manifest(sources: DataFrame, rows: int = 100_000) -> str:
    """JSON array of a registry, which is a dimension table of at most `rows` rows."""
    got = sources.orderBy(sources.columns[0]).limit(rows + 1).toJSON().collect()
    if len(got) > rows:
        raise ValueError(f"a manifest holds at most {rows} sources")
    return "[" + ",\n".join(got) + "]"


def json_safe(df: DataFrame) -> DataFrame:
    """Floating values, also inside arrays, structs and maps, rounded to 6 significant digits;
    those that are not finite become null."""

    def walk(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.FloatType | T.DoubleType):
            return significant(c.cast("double"), 6)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda k, v: walk(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def count_non_finite(df: DataFrame, column: str) -> DataFrame:
    """How many values of a double column or array of doubles are NaN or infinite."""
    kind = df.schema[column].dataType
    value = F.explode(column) if isinstance(kind, T.ArrayType) else F.col(column)
    rows = df.select(value.alias("v"))
    return rows.agg(F.count_if(F.col("v").isNotNull() & ~is_finite(F.col("v").cast("double"))).alias("non_finite"))
