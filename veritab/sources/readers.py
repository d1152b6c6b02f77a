"""Sources: named datasets (S1), JSON records (S2), dataset listing (S3).

CSV typing follows the reference's reader semantics (pandas-like): the usual
missing-value tokens become NULL, then a column is integer if every present
value is an integer, else double if every present value is a number, else
boolean for true/false text, else string. The decision is one aggregate pass
over the file on the executors; no sample is pulled to the driver.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.exprs import qcol
from veritab.session import ship_package
from veritab.sources.csv_ranges import read_csv_strings

# Text read as missing by the reference's CSV reader.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

# Names the reference always lists as datasets.
BUILT_IN_DATASETS = ["MNIST", "CIFAR-10", "Boston Housing", "Wine Quality", "Iris",
                     "Customer Churn"]

#: Endings by which a file counts as a dataset, in order of preference.
DATASET_ENDINGS = ("csv", "parquet", "json", "txt")
#: Words of a request that name no dataset.
GENERIC_WORDS = {"dataset", "data", "table", "the"}


def name_words(name: str) -> frozenset[str]:
    """The words of a dataset's name: letters and digits, lower case, without
    a file ending and without generic words."""
    stem, dot, ending = name.rpartition(".")
    words = re.findall(r"[a-z0-9]+", (stem if dot and ending.lower() in DATASET_ENDINGS else name).lower())
    return frozenset(w for w in words if w not in GENERIC_WORDS) or frozenset(words)


def list_folder(spark: SparkSession, folder: str) -> list[str]:
    """Paths in a folder of any file system that Spark can read."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(str(f.getPath()) for f in fs.listStatus(path)) if fs.exists(path) else []


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def resolve_dataset(spark: SparkSession, name: str, root: str) -> str:
    """Path of the dataset ``name``: itself if it is a path, else the file
    under ``root`` whose name shares the most words with it.

    Names are compared as sets of words. One set has to hold the other, so a
    single word of a name will do and words too many do no harm; among several
    the closest set wins, then the preferred ending, then the name.
    """
    if "/" in name and path_exists(spark, name):
        return name
    want = name_words(name)
    found = []
    for path in list_folder(spark, root):
        ending = path.rpartition(".")[2].lower()
        own = name_words(path.rpartition("/")[2])
        if ending in DATASET_ENDINGS and want and own and len(want & own) == min(len(want), len(own)):
            found.append((-len(want & own) / len(want | own), DATASET_ENDINGS.index(ending), path))
    if not found:
        raise FileNotFoundError(f"dataset {name!r} not found under {root}")
    return min(found)[2]


TYPING_COLUMNS = 20  # columns per typing aggregate


def infer_csv_types(df: DataFrame) -> DataFrame:
    """Cast all-string columns to int / bigint / double / boolean where every
    present value allows it (one aggregate pass)."""
    stats = {}
    for start in range(0, len(df.columns), TYPING_COLUMNS):
        checks = []
        for i, c in list(enumerate(df.columns))[start:start + TYPING_COLUMNS]:
            x = qcol(c)
            present, whole = x.isNotNull(), x.try_cast("bigint")
            checks += [
                F.count_if(present & whole.isNull()).alias(f"nl{i}"),
                F.count_if(present & x.try_cast("double").isNull()).alias(f"nd{i}"),
                F.count_if(present & ~F.lower(x).isin("true", "false")).alias(f"nb{i}"),
                F.min(whole).alias(f"mn{i}"), F.max(whole).alias(f"mx{i}"),
                F.count(x).alias(f"n{i}"),
            ]
        stats |= df.agg(*checks).first().asDict()
    out = []
    for i, c in enumerate(df.columns):
        x = qcol(c)
        if stats[f"n{i}"] == 0:
            out.append(x.cast("double").alias(c))     # all missing -> float, as pandas
        elif stats[f"nl{i}"] == 0:
            small = -2 ** 31 <= stats[f"mn{i}"] and stats[f"mx{i}"] < 2 ** 31
            out.append(x.cast("int" if small else "bigint").alias(c))
        elif stats[f"nd{i}"] == 0:
            out.append(x.cast("double").alias(c))
        elif stats[f"nb{i}"] == 0:
            out.append((F.lower(x) == "true").alias(c))
        else:
            out.append(x)
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             multi_line: bool = True) -> DataFrame:
    """CSV with header; quotes in quoted fields are doubled; missing tokens ->
    NULL; pandas-like types unless a schema is given (a declared schema is
    preferred at scale: no typing pass).

    Files are split at byte ranges; quoted fields may hold line breaks (see
    ``csv_ranges``). ``multi_line=False`` spares the look at the lines when the
    data is known to have none. A declared schema is matched by column name:
    other columns of the file are not read, a missing one is an error.
    """
    if multi_line:
        raw = read_csv_strings(spark, path)
    else:
        raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    if schema is None:
        return infer_csv_types(_without_tokens(raw, raw.columns))
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    missing = [f.name for f in declared if f.name not in raw.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {path}, which has {raw.columns}")
    nulls = _without_tokens(raw, declared.names)
    return nulls.select(*[qcol(f.name).cast(f.dataType).alias(f.name) for f in declared])


def _without_tokens(raw: DataFrame, columns: list[str]) -> DataFrame:
    return raw.select(*[F.when(qcol(c).isin(NA_TOKENS), None).otherwise(qcol(c)).alias(c) for c in columns])


def read_dataset(spark: SparkSession, name: str, root: str,
                 schema: T.StructType | str | None = None) -> DataFrame:
    """Resolve ``name`` under ``root`` and read it (S1). CSV, Parquet or JSON."""
    path = resolve_dataset(spark, name, root)
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending == "json":
        return read_records(spark, path, schema=schema)
    if ending in ("csv", "txt"):
        return read_csv(spark, path, schema)
    return spark.read.parquet(path)


def read_records(spark: SparkSession, source, column: str | None = None,
                 schema: T.StructType | str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Table from JSON records.

    ``source`` is a path (JSON lines or a JSON array file), or a DataFrame whose
    ``column`` holds one JSON object per row; the object's fields become
    columns next to the ``keep`` columns. Records that are no JSON object are
    left out (``count_records`` counts them). Without a schema, one inference
    pass on the executors merges the types of all records: whole numbers and
    others to double, any other mixture to string (its JSON text), objects
    field by field, arrays by their elements; a field that is always null is a
    string.
    """
    ship_package(spark)
    df, column = _record_column(spark, source, column)
    keep = keep or []
    records = df.where(_is_object(qcol(column))).select(*map(qcol, keep), qcol(column).alias("__record"))
    if schema is None:
        schema = infer_record_type(records, "__record")
    parsed = F.from_json("__record", schema)
    return records.select(*map(qcol, keep), parsed.alias("__rec")).select(*map(qcol, keep), "__rec.*")


def count_records(spark: SparkSession, source, column: str | None = None) -> DataFrame:
    """One row: ``records``, and how many of them were ``read`` and
    ``skipped`` because they are no JSON object."""
    df, column = _record_column(spark, source, column)
    good = _is_object(qcol(column))
    return df.agg(F.count(F.lit(1)).alias("records"), F.count_if(good).alias("read"), F.count_if(~good).alias("skipped"))


def _record_column(spark: SparkSession, source, column: str | None) -> tuple[DataFrame, str]:
    if not isinstance(source, str):
        return source, column
    if _is_json_array(spark, source):
        whole = spark.read.text(source, wholetext=True)
        return whole.select(F.explode(F.from_json("value", "array<string>")).alias("value")), "value"
    return spark.read.text(source).where(F.trim("value") != ""), "value"


def _is_object(c: Column) -> Column:
    return F.coalesce(F.ltrim(c).startswith("{") & F.try_parse_json(c).isNotNull(), F.lit(False))


def _paths(batches):
    """Distinct (path, kind) pairs of all values in the records of a task. A
    path has ``.name`` for a field and ``[]`` for the elements of an array."""
    found = set()

    def visit(value, path):
        kind = ("null" if value is None else "boolean" if isinstance(value, bool) else
                ("long" if -2 ** 63 <= value < 2 ** 63 else "double") if isinstance(value, int) else
                "double" if isinstance(value, float) else "string" if isinstance(value, str) else
                "struct" if isinstance(value, dict) else "array")
        found.add((path, kind))
        if kind == "struct":
            for k, v in value.items():
                visit(v, (*path, "." + k))
        elif kind == "array":
            for v in value:
                visit(v, (*path, "[]"))

    for batch in batches:
        for text in batch.column(0).to_pylist():
            visit(json.loads(text), ())
    if found:
        paths, kinds = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(list(map(list, paths)), pa.list_(pa.string())), pa.array(kinds)],
                                         names=["path", "kind"])


def infer_record_type(records: DataFrame, column: str) -> T.StructType:
    """The least type that holds every object of ``column``. Tasks send
    distinct (path, kind) pairs only; the driver gets one row per path, which
    is the size of the schema."""
    pairs = records.select(qcol(column)).mapInArrow(_paths, "path array<string>, kind string")
    rows = pairs.groupBy("path").agg(F.collect_set("kind").alias("kinds")).collect()
    kinds = {tuple(r["path"]): set(r["kinds"]) - {"null"} for r in rows}
    below: dict[tuple, list[tuple]] = {}
    for path in sorted(kinds):
        if path:
            below.setdefault(path[:-1], []).append(path)
    plain = {"boolean": T.BooleanType(), "long": T.LongType(), "double": T.DoubleType()}

    def merged(path: tuple) -> T.DataType:
        own, children = kinds.get(path, set()), below.get(path, [])
        if own == {"long", "double"}:
            return T.DoubleType()
        if own == {"struct"} and (children or not path):
            return T.StructType([T.StructField(p[-1][1:], merged(p)) for p in children])
        if own == {"array"}:
            return T.ArrayType(merged((*path, "[]")))
        return plain.get(next(iter(own)), T.StringType()) if len(own) == 1 else T.StringType()

    return merged(()) if kinds else T.StructType([])


def _is_json_array(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where(F.trim("value") != "").first()
    return first is not None and first["value"].lstrip().startswith("[")


def list_datasets(spark: SparkSession, root: str, pattern: str = "*.csv",
                  built_in: list[str] | None = None) -> DataFrame:
    """Dataset names: built-in names, then file names in Title Case, with a
    case-insensitive de-duplication (S3). Columns: name, source.

    The listing is a ``binaryFile`` scan that selects only ``path`` (file
    contents are never read).
    """
    built_in = BUILT_IN_DATASETS if built_in is None else built_in
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", False).load(root).select("path"))
    ext = re.escape(pattern.rsplit(".", 1)[-1]) if "." in pattern else ""
    base = F.regexp_extract(F.col("path"), r"([^/]+)$", 1)
    if ext:
        base = F.regexp_replace(base, r"\." + ext + "$", "")
    titled = F.initcap(F.regexp_replace(base, "_", " "))
    found = files.select(titled.alias("name"), F.lit("file").alias("source"), F.lit(1).alias("o"))
    known = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in built_in])).alias("name"),
                                  F.lit("built_in").alias("source"), F.lit(0).alias("o"))
    allx = known.unionByName(found)
    first = allx.groupBy(F.lower("name").alias("k")).agg(F.min(F.struct("o", "name", "source")).alias("s"))
    return first.select(F.col("s.name").alias("name"), F.col("s.source").alias("source"))
