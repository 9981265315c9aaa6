"""Readers: JSON lines, task files, run reports, raw simulator files, logs and file listings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MESSAGES = "array<struct<role: string, content: string>>"
CHAT = f"id string, task_id string, messages {MESSAGES}, score double, success boolean"
TRAJECTORY = (
    "id string, task_id string, steps array<struct<step_index: int, role: string, content: string, tool_call: struct<name: string, arguments: string, call_id: string>, "
    "tool_result: string, timestamp: timestamp>>, success boolean, final_score double, metadata map<string, string>, duration_seconds double"
)
RESULT = "task_id string, passed boolean, final_score double, steps int, wall_time_sec double, error string"
SPEC = "struct<min: double, max: double, target: double, weight: double, unit: string, at_freq: double>"
TASK = (
    f"id string, category string, pdk string, supply double, topology_hint string, load string, description string, specs map<string, {SPEC}>, "
    "corners array<string>, temp_range array<int>, pass_criteria string, difficulty string, _file string"
)


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Every *.jsonl of a folder; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(TRAJECTORY).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(path)


def chats(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """All chat files but prepared ones (train_*, val_*) and excluded names, with `_source` the
    file name; rows without messages are dropped. The file filter prunes whole files."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = spark.read.schema(CHAT).option("pathGlobFilter", "*.jsonl").json(path).withColumn("_source", name)
    return rows.filter(~F.col("_source").rlike("^(train_|val_)") & ~F.col("_source").isin(*excluded) & F.col("messages").isNotNull())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text, ok): lines of JSON files counted from 1; a broken line is not ok, not a
    crash. Files are read whole, as a line's number needs the lines before it."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    rows = files.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "text")).filter(F.trim("text") != "")
    return rows.select("file", (F.col("pos") + 1).alias("line"), "text", F.try_parse_json("text").isNotNull().alias("ok"))


def chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines with their messages, whichever synonyms of the keys they use."""
    schema = "conversations array<struct<role: string, from: string, content: string, value: string>>, messages array<struct<role: string, from: string, content: string, value: string>>"
    rows = numbered_lines(spark, path).withColumn("j", F.from_json("text", schema))
    turns = F.transform(
        F.coalesce("j.messages", "j.conversations"),
        lambda m: F.struct(F.coalesce(m["role"], m["from"]).alias("role"), F.coalesce(m["content"], m["value"]).alias("content")),
    )
    return rows.select("file", "line", "ok", turns.alias("messages"))


def run_report(spark: SparkSession, path: str) -> DataFrame:
    """Results of JSON run reports {model, results: [...]}."""
    fields = ", ".join(f"{n}: {t}" for n, t in (f.split(" ") for f in RESULT.split(", ")))
    doc = spark.read.schema(f"model string, results array<struct<{fields}>>").option("multiLine", True).json(path)
    return doc.select("model", F.explode("results").alias("r")).select("model", "r.*")


def tasks(spark: SparkSession, path: str, contains: str = "") -> DataFrame:
    """Task files (*.yaml, recursive), one row each; files without an id are skipped, an optional
    text must occur in the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.yaml").load(path)
    files = files.filter(F.contains("path", F.lit(contains))).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        keys = ("id", "category", "pdk", "supply", "topology_hint", "load", "description", "specs", "corners", "temp_range", "pass_criteria", "difficulty")
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                doc = yaml.safe_load(content.decode("utf-8"))
                if not isinstance(doc, dict) or "id" not in doc:
                    continue
                row = {k: doc.get(k) for k in keys}
                spec = lambda s: {"weight": 1.0, **{k: (float(s[k]) if k != "unit" else s[k]) for k in ("min", "max", "target", "weight", "unit", "at_freq") if s.get(k) is not None}}
                row["specs"] = {str(k): spec(v if isinstance(v, dict) else {"target": v}) for k, v in (row["specs"] or {}).items()}
                row["supply"] = None if row["supply"] is None else float(row["supply"])
                row["load"] = None if row["load"] is None else str(row["load"])
                rows.append({**row, "_file": path.rsplit("/", 1)[-1]})
            yield pd.DataFrame(rows, columns=[*keys, "_file"])

    return files.mapInPandas(parse, TASK)


def columns_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, name, value) of header CSV tables; a cell that is no number is null and keeps its row."""
    raw = spark.read.option("header", True).csv(path).withColumn("_row", F.monotonically_increasing_id()).withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    names = [c for c in raw.columns if c not in ("_row", "_file")]
    rows = raw.unpivot(["_file", "_row"], names, "name", "value")
    return rows.select(F.col("_file").alias("file"), F.col("_row").alias("row"), "name", F.col("value").try_cast("double").alias("value"))


def logs(spark: SparkSession, path: str) -> DataFrame:
    """Per log file: converged, warnings and errors (a line with Warning is no error), failed."""
    rows = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    warning = F.contains("value", F.lit("Warning"))
    error = ~warning & F.contains("value", F.lit("Error"))
    return rows.groupBy("file").agg(
        (~F.bool_or(F.lower("value").rlike("no convergence|failed to converge"))).alias("converged"),
        F.count_if(warning).alias("warnings"), F.count_if(error).alias("errors"), F.bool_or(F.contains("value", F.lit("FAILED"))).alias("failed"),
    )


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(suffix, files, bytes) of a folder tree, case-insensitive; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.withColumn("suffix", suffix).filter(F.col("suffix").isin(*suffixes)).groupBy("suffix").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


#: Names a sweep's axis has in raw files.
AXES = ("time", "frequency", "v-sweep", "temp-sweep", "i-sweep")
RAW = "run string, variable string, i int, re double, im double"


def parse_raw(data: bytes) -> pd.DataFrame:
    """(variable, i, re, im) of a binary simulator file: a text header, then doubles row by row,
    16 bytes a value when complex. A cut tail gives what was read; a bad header gives nothing."""
    nothing = pd.DataFrame({"variable": pd.Series(dtype=str), "i": pd.Series(dtype="int32"), "re": pd.Series(dtype=float), "im": pd.Series(dtype=float)})
    head, mark, body = data.partition(b"Binary:\n")
    if not mark:
        return nothing
    fields, names = {}, []
    for line in head.decode("utf-8", errors="ignore").splitlines():
        if line[:1] in ("\t", " ") and len(line.split()) >= 2:
            names.append(line.split()[1])
        elif ":" in line:
            key, _, value = line.partition(":")
            fields[key.strip().lower()] = value.strip()
    try:
        n_vars, n_points = int(fields["no. variables"]), int(fields["no. points"])
    except (KeyError, ValueError):
        return nothing
    if len(names) != n_vars or not n_vars:
        return nothing
    kind = np.dtype("<c16" if "complex" in fields.get("flags", "").lower() else "<f8")
    n = min(n_points * n_vars, len(body) // kind.itemsize)
    got = np.frombuffer(body, kind, n)
    at = np.arange(n)
    im = got.imag if kind.kind == "c" else np.full(n, np.nan)
    out = pd.DataFrame({"variable": np.array(names, object)[at % n_vars], "i": (at // n_vars).astype(np.int32), "re": got.real, "im": im})
    return out if kind.kind == "c" else out.assign(im=pd.array([None] * n, dtype="Float64"))


def raw_results(spark: SparkSession, path: str) -> DataFrame:
    """(run, variable, i, re, im) of all *.raw files, one task per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.raw").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                got = parse_raw(content)
                got.insert(0, "run", path.rsplit("/", 1)[-1].removesuffix(".raw"))
                yield got

    return files.mapInPandas(parse, RAW)


def results(raw: DataFrame) -> DataFrame:
    """(run, variable, kind, samples) from raw rows: the axis goes by its name; one point is an
    operating point, more a sweep; vectors of another length than the axis and values that are
    not finite are dropped; complex vectors also give magnitudes in dB and phases."""
    re, im = F.col("re"), F.col("im")
    finite = ~F.isnan(re) & (F.abs(re) < F.lit(float("inf")))
    rows = raw.filter(finite)
    axis = rows.filter(F.lower("variable").isin(*AXES)).groupBy("run").agg(F.min("variable").alias("axis"))
    x = rows.join(axis, "run").filter("variable = axis").select("run", "i", F.col("re").alias("x"))
    n = x.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    mag, deg = F.sqrt(re * re + im * im), F.degrees(F.atan2(im, re))
    db = F.when(mag > 0, 20 * F.log10(mag))
    parts = rows.join(axis, "run", "left").filter("axis is null or variable <> axis")
    real = parts.filter(im.isNull()).select("run", "i", "variable", re.alias("y"))
    bent = parts.filter(im.isNotNull())
    dbs = bent.select("run", "i", F.concat(F.lit("vdb("), "variable", F.lit(")")).alias("variable"), db.alias("y"))
    degs = bent.select("run", "i", F.concat(F.lit("vp("), "variable", F.lit(")")).alias("variable"), deg.alias("y"))
    long = real.union(dbs).union(degs).join(x, ["run", "i"], "left").join(n, "run", "left")
    out = long.groupBy("run", "variable").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("samples"), F.max("n").alias("n"))
    out = out.filter(F.col("n").isNull() | (F.size("samples") == F.col("n")))
    kind = F.when(F.coalesce("n", F.lit(1)) <= 1, "op").otherwise("sweep")
    return out.select("run", "variable", kind.alias("kind"), F.transform("samples", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("samples"))


class MockSimulator(DataSource):
    """Deterministic simulator results: format("mocksim") with options analysis, runs, points, corner.

    ac: a single-pole response in dB over a log sweep; dc: a saturating transfer curve; tran: a
    first-order step; noise: a flat floor with a 1/f corner; mc: one value a point, spread by a
    fixed low-discrepancy sequence. Corner ss is derated by 0.8, ff raised by 1.2, whatever else
    is nominal. No random numbers, so results can be checked.
    """

    @classmethod
    def name(cls) -> str:
        return "mocksim"

    def schema(self) -> str:
        return "run long, corner string, i int, x double, y double"

    def reader(self, schema):
        return MockReader(self.options)


class MockReader(DataSourceReader):
    def __init__(self, options):
        self.runs, self.points = int(options.get("runs", 4)), int(options.get("points", 101))
        self.corner, self.analysis = options.get("corner", "tt"), options.get("analysis", "ac")

    def partitions(self):
        return [InputPartition(r) for r in range(self.runs)]

    def read(self, partition):
        import math

        run = partition.value
        factor = {"ss": 0.8, "ff": 1.2}.get(self.corner, 1.0)
        last = max(1, self.points - 1)
        for i in range(self.points):
            if self.analysis == "ac":
                x = 10 ** (i * 8 / last)
                y = 40 + run - 10 * math.log10(1 + (x / 1e4) ** 2)
            elif self.analysis == "dc":
                x = i * 1.8 / last
                y = 1.8 / (1 + math.exp((x - 0.9) * (10 + run)))
            elif self.analysis == "tran":
                x = i * 1e-6 / last
                y = 1 - math.exp(-x * (5e6 + 1e6 * run))
            elif self.analysis == "noise":
                x = 10 ** (1 + i * 5 / last)
                y = (10 + run) * math.sqrt(1 + 1e3 / x)
            elif self.analysis == "mc":
                x = float(i)
                y = 1.2 + 0.01 * ((i * 0.6180339887498949) % 1 - 0.5) + 0.001 * run
            else:
                raise ValueError(f"no analysis {self.analysis}")
            yield run, self.corner, i, x, factor * y


#: Adapters by name, each a function of (spark, options) that gives (run, corner, i, x, y).
ADAPTERS = {"mock": lambda spark, **options: _mock(spark, options)}


def _mock(spark: SparkSession, options: dict) -> DataFrame:
    spark.dataSource.register(MockSimulator)
    return spark.read.format("mocksim").options(**options).load()


def adapter(name: str):
    """The simulator adapter of a name; unknown names are refused with those that are known."""
    if name not in ADAPTERS:
        raise ValueError(f"no adapter {name!r}; there are {sorted(ADAPTERS)}")
    return ADAPTERS[name]


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a manifest, a JSON array."""
    schema = "id string, name string, category string, license string, license_compatible boolean, url string, token_count long, notes string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def trainer_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, step, loss) of every trainer_state.json below a folder; entries without loss are left out."""
    schema = "log_history array<struct<step: long, loss: double>>"
    files = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "trainer_state.json").option("multiLine", True).json(path)
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.explode("log_history").alias("e"))
    return rows.select("file", "e.step", "e.loss").filter("loss is not null")


def first_chats(spark: SparkSession, path: str, n: int, excluded: tuple[str, ...] = ()) -> DataFrame:
    """The first n chats in order of id (the feature is the limit): those of prepared files
    (train_*) if the folder has any, else all."""
    prepared = spark.read.schema(CHAT).option("pathGlobFilter", "train_*.jsonl").json(path).filter(F.col("messages").isNotNull())
    rows = chats(spark, path, excluded).drop("_source") if prepared.limit(1).count() == 0 else prepared
    return rows.orderBy("id").limit(n)
