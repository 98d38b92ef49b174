"""Readers of measured data and of grid tasks, and their names. All read paths that Spark reads, remote ones too; none
downloads to this machine."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.sources.names import PROCESS, RESPIRATION
from undula.sources.workbooks import checked_workbook, workbooks  # noqa: F401


@dataclass(frozen=True)
class SourceInfo:
    """Where a table is from and how it was made; Spark's tables carry no such notes."""

    name: str
    origin: str
    parameters: dict[str, object] = field(default_factory=dict)


# ---- respiration records ----

# The published records' numbers and kinds, and how the signals are measured.
SUBJECTS = range(1, 54)
KINDS = {"Signals": "csv", "Numerics": "csv", "Breaths": "csv", "Fix": "txt"}


def _one_of(what: str, value: object, allowed) -> object:
    """value, if it is one of those allowed; numbers must be integers."""
    if isinstance(allowed, range) and (isinstance(value, bool) or not isinstance(value, int)):
        raise TypeError(f"{what}: an integer is needed, not {value!r}")
    if value not in allowed:
        raise ValueError(f"{what}: {value!r} isn't one of {allowed}")
    return value


def respiration_filename(subject: int, kind: str = "Signals") -> str:
    ending = KINDS[_one_of("kind of record", kind, tuple(KINDS))]
    return f"bidmc_{_one_of('subject', subject, SUBJECTS):02d}_{kind}.{ending}"


def stripped(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip() for c in df.columns))


def respiration_raw(spark: SparkSession, folder: str, subject: int, kind: str = "Signals") -> DataFrame:
    """A subject's CSV with its own column names and a column subject."""
    return _records(spark, folder, (subject,), kind)


def _records(spark: SparkSession, folder: str, subjects: Sequence[int], kind: str) -> DataFrame:
    """CSVs of one kind, whose headers must be alike, read at once: the first line of one file gives the names, and all
    values are numbers."""
    if kind == "Fix":
        raise ValueError("Fix is a text file, not a table")
    paths = [f"{folder}/{respiration_filename(s, kind)}" for s in subjects]
    header = spark.read.text(paths[0]).first()
    if header is None:
        raise ValueError(f"{paths[0]} is empty")
    names = [c.strip() for c in header[0].split(",")]
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in names])
    df = spark.read.csv(paths, header=True, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    return df.withColumn("subject", F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)_", 1).cast("int"))


def respiration(spark: SparkSession, folder: str, subjects: Sequence[int] = (1,)) -> DataFrame:
    """Signals of some subjects under plain names, in one read. Files whose header differs from the first one's are read
    apart, and their other columns are null elsewhere."""
    by_header: dict[str, list[int]] = {}
    for s in subjects:
        first = spark.read.text(f"{folder}/{respiration_filename(s)}").first()
        by_header.setdefault(re.sub(r"\s*,\s*", ",", first[0].strip()) if first else "", []).append(s)
    out = None
    for own in by_header.values():
        part = _records(spark, folder, own, "Signals").withColumnsRenamed(RESPIRATION)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no subject is asked for")
    return out


# ---- process runs ----

# The published data sets, their other spellings, numbers of modes, faults and runs, and the files' names.
FAULTY, FAULT_FREE = "faulty_training", "faultfree_training"
SPELLINGS = {FAULTY: FAULTY, FAULT_FREE: FAULT_FREE, "fault_free_training": FAULT_FREE}
MODES, FAULTS, RUNS = range(1, 7), range(1, 22), range(1, 11)
FAULTY_FILE, FAULT_FREE_FILE = "mode{mode}_{fault}_{run}.{suffix}", "mode{mode}_normal_50.{suffix}"
FAULTY_FOLDER, FAULT_FREE_FOLDER = "simulations/mode_{mode}/faults", "simulations/mode_{mode}"


def dataset_name(name: str) -> str:
    """The plain name of a data set, whatever its case, with dashes or underscores."""
    if not isinstance(name, str):
        raise TypeError(f"data set: a string is needed, not {name!r}")
    return SPELLINGS[_one_of("data set", re.sub("-", "_", name.strip().lower()), tuple(SPELLINGS))]


def run_filename(fault: int, run: int, mode: int = 1, dataset: str = FAULTY, suffix: str = "xlsx") -> str:
    form = FAULT_FREE_FILE if dataset_name(dataset) == FAULT_FREE else FAULTY_FILE
    numbers = {"mode": _one_of("mode", mode, MODES)}
    if form is FAULTY_FILE:
        numbers |= {"fault": _one_of("fault", fault, FAULTS), "run": _one_of("run", run, RUNS)}
    return form.format(**numbers, suffix=suffix)


def run_url(base: str, fault: int, run: int, mode: int = 1, dataset: str = FAULTY) -> str:
    """Where a run lies below the address of a published copy."""
    folder = FAULT_FREE_FOLDER if dataset_name(dataset) == FAULT_FREE else FAULTY_FOLDER
    return "/".join((base.rstrip("/"), folder.format(mode=mode), run_filename(fault, run, mode, dataset)))


def run_catalogue(spark: SparkSession, mode: int = 1, base: str = "", faults: Sequence[int] = FAULTS, runs: Sequence[int] = RUNS, fault_free: bool = False) -> DataFrame:
    """dataset, mode, fault_number, simulation_run, filename and path of every run; fault_free: with the run without
    fault (fault 0, run 1)."""
    numbers = [F.explode(F.array(*(F.lit(x).cast("long") for x in values))) for values in (faults, runs)]
    rows = spark.range(1).select(F.lit(FAULTY).alias("dataset"), F.lit(_one_of("mode", mode, MODES)).alias("mode"), numbers[0].alias("fault_number"))
    rows = rows.select("*", numbers[1].alias("simulation_run"))
    name = F.format_string(FAULTY_FILE.format(mode=mode, fault="%d", run="%d", suffix="xlsx"), "fault_number", "simulation_run")
    rows = rows.withColumn("filename", name).withColumn("path", F.concat(F.lit(f"{base}/{FAULTY_FOLDER.format(mode=mode)}/"), name))
    if fault_free:
        free = run_filename(0, 1, mode, FAULT_FREE)
        one = (FAULT_FREE, mode, 0, 1, free, f"{base}/{FAULT_FREE_FOLDER.format(mode=mode)}/{free}")
        rows = rows.unionByName(spark.createDataFrame([one], rows.schema))
    return rows


def snake(name: str) -> str:
    return re.sub(r"__+", "_", re.sub(r"[ .\-/\\]", "_", name.strip().lower())).strip("_")


def standard_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"faultNumber": "fault_number", "simulationRun": "simulation_run"}).transform(lambda d: d.toDF(*map(snake, d.columns)))


def repaired_headers(df: DataFrame) -> DataFrame:
    """The fault-free file names its 41 measurements like valves; anything else is an error."""
    if [snake(c) for c in df.columns] != ["time", *(f"xmv_{k}" for k in range(1, 42))]:
        raise ValueError("expected time and xmv_1 to xmv_41")
    return df.toDF("time", *(f"xmeas_{k}" for k in range(1, 42)))


def process_run(spark: SparkSession, path: str, fault: int, run: int, dataset: str = FAULTY) -> DataFrame:
    """One run from CSV, Parquet or XLSX, under plain names with its keys."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.endswith(".xlsx"):
        df = workbooks(spark, [path]).drop("path")
    else:
        df = spark.read.csv(path, header=True, inferSchema=True)
    free = dataset_name(dataset) == FAULT_FREE
    df = standard_columns(repaired_headers(stripped(df)) if free else stripped(df)).withColumnsRenamed(PROCESS)
    return df.withColumns({"fault_number": F.lit(0 if free else fault).cast("long"), "simulation_run": F.lit(run).cast("long")})


def process_runs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Faulty runs from many XLSX workbooks in one read, under plain names; fault and run are those of the files' names, and
    a file of another name is an error."""
    shape = re.compile(FAULTY_FILE.format(mode=r"\d+", fault=r"(\d+)", run=r"(\d+)", suffix="xlsx").replace(".", r"\."))
    for p in paths:
        if not shape.fullmatch(p.rpartition("/")[2]):
            raise ValueError(f"{p} doesn't name a fault and a run")
    df = workbooks(spark, paths).withColumnRenamed("path", "_path")
    df = standard_columns(stripped(df)).withColumnsRenamed(PROCESS)
    number = lambda k: F.regexp_extract("path", shape.pattern + "$", k).cast("long")
    return df.withColumns({"fault_number": number(1), "simulation_run": number(2)}).drop("path")


def save(df: DataFrame, path: str, overwrite: bool = False) -> str:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return path


def cached(spark: SparkSession, path: str, make, refresh: bool = False) -> DataFrame:
    """The table at path, made first where it isn't there: below another name, which becomes path once it is whole, so
    that no reader meets a part of it."""
    where, part = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.part"))
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if refresh or not files.exists(where):
        make().write.mode("overwrite").parquet(part.toString())
        files.delete(where, True)
        if not files.rename(part, where):
            raise OSError(f"{part} could not be renamed")
    return spark.read.parquet(path)


def clear(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# ---- grid tasks ----

_GRID = "array<array<int>>"
TASK = f"struct<train:array<struct<input:{_GRID},output:{_GRID}>>,test:array<struct<input:{_GRID},output:{_GRID}>>>"
CELLS = ("task_id", "split", "pair_type", "pair_index", "grid_role", "row", "column", "color", "grid_height", "grid_width")


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """task_id and task of JSON files with a task each, named by their file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("task_id"), F.from_json("value", TASK).alias("task"))


def challenges(spark: SparkSession, path: str) -> DataFrame:
    """task_id and task of a JSON file that maps ids to tasks."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{TASK}>")).alias("task_id", "task"))


def cells(tasked: DataFrame, split: str = "training") -> DataFrame:
    """A row per cell of every grid of every task. A test's output may be missing."""
    if split not in ("training", "evaluation"):
        raise ValueError("split must be training or evaluation")
    pairs = None
    for kind in ("train", "test"):
        part = tasked.select("task_id", F.lit(kind).alias("pair_type"), F.posexplode(f"task.{kind}").alias("pair_index", "pair"))
        pairs = part if pairs is None else pairs.unionByName(part)
    roles = F.explode(F.array(F.struct(F.lit("input").alias("grid_role"), F.col("pair.input").alias("grid")), F.struct(F.lit("output").alias("grid_role"), F.col("pair.output").alias("grid"))))
    grids = pairs.select("task_id", "pair_type", "pair_index", roles.alias("g")).select("task_id", "pair_type", "pair_index", "g.grid_role", "g.grid").where("grid IS NOT NULL")
    rows = grids.select("*", F.size("grid").alias("grid_height"), F.size(F.col("grid")[0]).alias("grid_width"), F.posexplode("grid").alias("row", "colors"))
    made = rows.select("*", F.posexplode("colors").alias("column", "color")).withColumn("split", F.lit(split))
    return made.select(*CELLS)


def invalid_grids(tasked: DataFrame) -> DataFrame:
    """task_id of tasks with a malformed id, an empty or ragged grid, or colors beyond 0 to 9."""
    every = F.concat(*(F.flatten(F.transform(f"task.{k}", lambda p: F.array(p["input"], p["output"]))) for k in ("train", "test")))
    bad = F.exists(F.filter(every, lambda g: g.isNotNull()), lambda g: (F.size(g) == 0) | F.exists(g, lambda r: (F.size(r) != F.size(g[0])) | (F.size(r) == 0) | F.exists(r, lambda c: c.isNull() | (c < 0) | (c > 9))))
    return tasked.where(~F.col("task_id").rlike("^[0-9a-f]{8}$") | F.col("task").isNull() | bad).select("task_id")


def grid_task(spark: SparkSession, folder: str, task_id: str, split: str = "training") -> DataFrame:
    """The cells of one task; ValueError unless it is well formed."""
    if not re.fullmatch(r"[0-9a-f]{8}", task_id):
        raise ValueError("a task id has eight hexadecimal digits")
    one = tasks(spark, f"{folder}/{task_id}.json")
    if invalid_grids(one).limit(1).count():
        raise ValueError(f"task {task_id} is malformed")
    return cells(one, split)
