"""File sources and sinks: delimited text, Parquet, JSON tables, sheets, and upserts."""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import q
from ..operators.ranking import upsert


def read_tsv(spark: SparkSession, path: str, wanted: Sequence[str] | None = None, parts: int | None = None, drop_bad: bool = False, limit: int | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A tab-separated dump as strings, quotes being ordinary signs; gzip files too.

    ``wanted``: columns to keep, of those that the header has. A gzip file is one task's to read, so ``parts`` deals its rows out afterwards. ``drop_bad`` skips rows with too many or too few fields, for which all columns are read.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("encoding", encoding)
    df = reader.option("mode", "DROPMALFORMED" if drop_bad else "PERMISSIVE").option("columnPruning", not drop_bad).csv(path)
    if wanted is not None:
        df = df.select(*(q(c) for c in wanted if c in df.columns))
    if limit is not None:
        df = df.limit(limit)
    return df.repartition(parts) if parts else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, infer: bool = True, encoding: str = "UTF-8", recursive: bool = False, pattern: str | None = None, fallback: str | None = None) -> DataFrame:
    """Comma-separated files with a header; with a schema no job is spent on types. ``recursive`` and ``pattern`` find files below a folder.

    ``fallback``: the encoding of files that aren't valid UTF-8, such as latin1. One pass over the lines finds them; only file names and a flag of each reach the driver. All files have the same columns then.
    """
    def options(reader):
        reader = reader.option("recursiveFileLookup", recursive)
        return reader.option("pathGlobFilter", pattern) if pattern else reader

    def load(paths: str | list[str], encoding: str, schema: T.StructType | str | None) -> DataFrame:
        reader = options(spark.read).option("header", True).option("encoding", encoding)
        return reader.schema(schema).csv(paths) if schema else reader.option("inferSchema", infer).csv(paths)

    if not fallback:
        return load(path, encoding, schema)
    lines = options(spark.read).text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
    found = lines.groupBy("file").agg(F.bool_and("valid").alias("valid")).collect()
    kinds = {code: [r.file for r in found if r.valid == valid] for valid, code in ((True, encoding), (False, fallback))}
    if not kinds[fallback]:
        return load(path, encoding, schema)
    # Types follow from all files, names from those that are read as they should be.
    known = schema or load(path, fallback, None).schema
    if not schema and kinds[encoding]:
        known = T.StructType([T.StructField(n, f.dataType) for n, f in zip(load(kinds[encoding], encoding, None).columns, known, strict=True)])
    return reduce(DataFrame.unionByName, (load(files, code, known) for code, files in kinds.items() if files))


_SHEET = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _sheet_rows(book: zipfile.ZipFile, target: str, shared: Sequence[str]) -> list[list[str | None]]:
    """The cells of a sheet as texts, row by row; rows and cells that the file leaves out are empty."""
    rows: list[list[str | None]] = []
    for row in ElementTree.fromstring(book.read(target)).iterfind(".//m:sheetData/m:row", _SHEET):
        at = int(row.get("r", len(rows) + 1)) - 1
        rows += [[] for _ in range(at + 1 - len(rows))]
        for cell in row.iterfind("m:c", _SHEET):
            letters = re.match("[A-Z]*", cell.get("r", ""))[0]
            col = reduce(lambda n, x: 26 * n + ord(x) - 64, letters, 0) - 1 if letters else len(rows[at])
            rows[at] += [None] * (col + 1 - len(rows[at]))
            value = cell.findtext("m:v", None, _SHEET)
            if cell.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif cell.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in cell.iterfind(".//m:t", _SHEET))
            rows[at][col] = value
    return rows


def read_workbook(spark: SparkSession, path: str, sheets: Sequence[str], header: int = 2, keys: Sequence[str] = ("food_code", "description")) -> dict[str, DataFrame]:
    """Tables, as texts, of the sheets of an xlsx workbook that are there. ``header``: rows before the one with the names; the first columns get the ``keys`` as names, unnamed others are left out.

    A workbook is one small file, so the driver reads it, by whatever file system Spark does.
    """
    content = spark.read.format("binaryFile").load(path).first().content
    out = {}
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        texts = ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", _SHEET) if "xl/sharedStrings.xml" in book.namelist() else []
        shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", _SHEET)) for si in texts]
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind(".//m:sheet", _SHEET):
            if sheet.get("name") not in sheets:
                continue
            file = target[sheet.get(f"{{{_SHEET['r']}}}id")]
            rows = _sheet_rows(book, file.lstrip("/") if file.startswith("/") else f"xl/{file}", shared)
            top = rows[header] if len(rows) > header else []
            names = [*keys, *top[len(keys) :]]
            used = [k for k, n in enumerate(names) if n]
            body = [tuple(r[k] if k < len(r) else None for k in used) for r in rows[header + 1 :] if any(x is not None for x in r)]
            out[sheet.get("name")] = spark.createDataFrame(body, T.StructType([T.StructField(names[k], T.StringType()) for k in used]))
    return {s: out[s] for s in sheets if s in out}


def read_sheets(spark: SparkSession, folder: str, sheets: Sequence[str], keys: Sequence[str] = ("food_code", "description")) -> list[DataFrame]:
    """One table a sheet from ``<folder>/<sheet>.csv``, the first two columns named as the keys; sheets without a file are left out."""
    out = []
    for sheet in sheets:
        try:
            df = read_csv(spark, f"{folder}/{sheet}.csv", infer=False)
        except Exception as e:  # only a missing path
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out.append(df.withColumnsRenamed(dict(zip(df.columns, keys, strict=False))))
    return out


def read_json_table(spark: SparkSession, path: str) -> object:
    """A small JSON document, by whatever file system Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def read_foods(df: DataFrame, id_cols: Sequence[str], name: str, nutrients: Mapping[str, str], needs_name: bool = True) -> DataFrame:
    """(id, name, calories, nutrients map): records of a wide table, unreadable or missing amounts 0. ``nutrients``: column by nutrient; "calories" is one of them. The id is the first of ``id_cols`` that is there."""
    number = lambda c: F.nanvl(F.coalesce(q(c).try_cast("double"), F.lit(0.0)), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    there = {n: c for n, c in nutrients.items() if n != "calories"}
    amounts = F.create_map(*(x for n, c in there.items() for x in (F.lit(n), number(c))))
    out = df.where(F.trim(q(name)) != "") if needs_name else df
    ids = F.coalesce(*(q(c).cast("string") for c in [*id_cols, name] if c in df.columns))
    return out.select(ids.alias("id"), q(name).alias("name"), number(nutrients["calories"]).alias("calories"), amounts.alias("nutrients"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    """A folder of parts, each with a header; ``mode`` append adds parts."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def append_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Adds rows to one CSV file that has one header, written when the file is new. For small files: all of it passes the driver at each append; ``write_csv`` appends parts.

    Parts are written by tasks and joined stream by stream; the file is replaced at the end, so a failed run changes nothing. Other columns than the file's are an error.
    """
    context = df.sparkSession.sparkContext
    java, conf = context._jvm, context._jsc.hadoopConfiguration()
    at = lambda p: java.org.apache.hadoop.fs.Path(p)
    target, made = at(path), at(f"{path}.new-{uuid.uuid4().hex}")
    system = target.getFileSystem(conf)
    quoted = lambda c: '"' + c.replace("\\", "\\\\").replace('"', '\\"') + '"' if any(x in c for x in (sep, '"', "\n", "\r")) else c
    header = sep.join(map(quoted, df.columns))
    if system.exists(target):
        there = df.sparkSession.read.option("header", True).option("sep", sep).csv(path).columns
        if there != df.columns:
            raise ValueError(f"{path} has the columns {there}")
    parts = at(f"{path}.parts-{uuid.uuid4().hex}")
    df.write.option("header", False).option("sep", sep).csv(parts.toString())
    files = sorted(f.getPath().toString() for f in system.listStatus(parts) if f.getPath().getName().startswith("part-"))
    sink = system.create(made)
    if not system.exists(target):
        sink.write(bytearray(f"{header}\n".encode()))
    for source in [target, *map(at, files)]:
        if system.exists(source):
            stream, size = system.open(source), system.getFileStatus(source).getLen()
            java.org.apache.hadoop.io.IOUtils.copyBytes(stream, sink, conf, False)
            if size:  # a last line without an end isn't joined with the next row
                stream.seek(size - 1)
                if stream.read() != 10:
                    sink.write(bytearray(b"\n"))
            stream.close()
    sink.close()
    system.delete(parts, True)
    if system.exists(target):
        system.delete(target, False)
    system.rename(made, target)


def fetch_file(get: Callable[[str], Iterable[bytes]], url: str, folder: str) -> str:
    """The path of a file below ``folder``, got in pieces by ``get(url)`` unless it is there; it appears whole or not at all."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, url.rstrip("/").rsplit("/", 1)[-1].split("?")[0])
    if not os.path.exists(path):
        part = f"{path}.part-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for piece in get(url):
                f.write(piece)
        os.replace(part, path)
    return path


def unpack(path: str, folder: str) -> str:
    """Extracts a zip or tar archive, compressed or not, unless the folder is there. Members that would leave the folder are an error."""
    if not os.path.isdir(folder):
        part = f"{folder}.part-{uuid.uuid4().hex}"
        if zipfile.is_zipfile(path):
            with zipfile.ZipFile(path) as z:
                z.extractall(part)
        else:
            with tarfile.open(path) as t:
                t.extractall(part, filter="data")
        os.replace(part, folder)
    return folder


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def upsert_parquet(spark: SparkSession, path: str, new: DataFrame, key: str) -> str:
    """Merges new rows into the current version of a table folder and returns the new version's path.

    A version is written beside the old one and named in ``<path>/current`` last, so readers never see half a table and a failed run changes nothing.
    """
    old = current_version(spark, path)
    merged = upsert(spark.read.parquet(old), new, key) if old else upsert(new.where("false"), new, key)
    version = f"{path}/v-{uuid.uuid4().hex}"
    merged.write.parquet(version)
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.text(f"{path}/current").first()
    except Exception as e:  # only a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return row.value if row else None


def html_report(df: DataFrame, rows: int = 500) -> str:
    """A small result as an HTML table."""
    return df.limit(rows).toPandas().to_html(index=False)


# The six foods of the mock source.
MOCK_FOODS = [
    ("1", "Chicken Breast", 165.0, {"protein": 31.0, "fat": 3.6, "carbohydrate": 0.0, "Vitamin A (mcg RAE)": 0.0, "Vitamin C (mg)": 0.0}, 150.0),
    ("2", "Brown Rice", 111.0, {"protein": 2.6, "fat": 0.9, "carbohydrate": 23.0, "Vitamin A (mcg RAE)": 0.0, "Vitamin C (mg)": 0.0}, 150.0),
    ("3", "Broccoli", 34.0, {"protein": 2.8, "fat": 0.4, "carbohydrate": 7.0, "Vitamin A (mcg RAE)": 623.0, "Vitamin C (mg)": 89.0}, 100.0),
    ("4", "Almonds", 579.0, {"protein": 21.0, "fat": 49.0, "carbohydrate": 22.0, "Vitamin A (mcg RAE)": 1.0, "Vitamin C (mg)": 0.0}, 30.0),
    ("5", "Olive Oil", 884.0, {"protein": 0.0, "fat": 100.0, "carbohydrate": 0.0, "Vitamin A (mcg RAE)": 0.0, "Vitamin C (mg)": 0.0}, 15.0),
    ("6", "Spinach", 23.0, {"protein": 2.9, "fat": 0.4, "carbohydrate": 3.6, "Vitamin A (mcg RAE)": 9377.0, "Vitamin C (mg)": 28.0}, 100.0),
]


def mock_foods(spark: SparkSession) -> DataFrame:
    """Six foods for tests and demonstrations."""
    return spark.createDataFrame(MOCK_FOODS, "id string, name string, calories double, nutrients map<string,double>, portion_size double")
