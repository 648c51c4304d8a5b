"""Reading and writing tables: CSV, JSON columns, crystal files beside a table of targets, Excel where a reader is installed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fields of the JSON description of a structure in an ``atoms`` column.
ATOMS = "lattice_mat array<array<double>>, coords array<array<double>>, elements array<string>, abc array<double>, angles array<double>, cartesian boolean"


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """Give a schema for large files; without one Spark reads the file twice to infer it."""
    reader = spark.read.option("sep", sep).option("encoding", encoding).option("header", header)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    df.write.option("sep", sep).option("encoding", encoding).option("header", True).csv(path)


def read_excel(spark: SparkSession, path: str, **options) -> DataFrame:
    """Small files only, through pandas; raises where no Excel engine is installed."""
    try:
        import openpyxl  # noqa: F401
    except ModuleNotFoundError as missing:
        raise RuntimeError("reading Excel files needs openpyxl, which is not installed") from missing
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, **options))


def atom_sites(text: str | None) -> list[dict] | None:
    """(element, x, y, z) of the first loop of a CIF text that has fractional coordinates; None without one. Uncertainties in brackets are dropped, and a
    coordinate that is no number is missing."""
    names: list[str] = []
    rows: list[dict] = []
    in_header = False
    for line in map(str.strip, (text or "").splitlines()):
        if line.lower() == "loop_":
            if rows:
                break
            names, in_header = [], True
        elif line.startswith("_"):
            if rows:
                break
            names = [*names, line.split()[0].lower()] if in_header else []
        elif line and not line.startswith("#") and "_atom_site_fract_x" in names:
            in_header = False
            values = dict(zip(names, re.findall(r"'[^']*'|\"[^\"]*\"|\S+", line)))
            symbol = re.match(r"[A-Za-z]{1,2}", values.get("_atom_site_type_symbol", values.get("_atom_site_label", "")))
            rows.append({"element": symbol.group() if symbol else None, **{c: _number(values.get(f"_atom_site_fract_{c}")) for c in "xyz"}})
        else:
            in_header = False
    return rows or None


def _number(text: str | None) -> float | None:
    found = re.fullmatch(r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)(?:\(\d+\))?", text or "")
    return float(found.group(1)) if found else None


def read_structures(spark: SparkSession, folder: str) -> DataFrame:
    """(cif_id, name, lengths, angles, content, atoms) of every ``*.cif`` file in a folder. A file without a tag has null for it; atoms are those of
    ``atom_sites``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.cif").load(folder)
    text = F.decode("content", "UTF-8")
    number = lambda tag: F.nullif(F.regexp_extract("content", rf"(?m)^\s*{tag}\s+([-+0-9.eE]+)", 1), F.lit("")).cast("double")
    sites = F.udf(atom_sites, "array<struct<element: string, x: double, y: double, z: double>>")
    named = files.select(F.regexp_extract("path", r"([^/]+)\.cif$", 1).alias("cif_id"), text.alias("content"))
    return named.select("cif_id", F.nullif(F.regexp_extract("content", r"(?m)^\s*data_(\S+)", 1), F.lit("")).alias("name"), F.array(*[number(f"_cell_length_{a}") for a in "abc"]).alias("lengths"), F.array(*[number(f"_cell_angle_{a}") for a in ("alpha", "beta", "gamma")]).alias("angles"), "content", sites("content").alias("atoms"))


def match_targets(records: DataFrame, targets: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records with their targets, records without one, and targets without a record."""
    return records.join(targets, key), records.join(targets, key, "left_anti"), targets.join(records, key, "left_anti")


def parse_json(df: DataFrame, col: str, schema: str = ATOMS) -> DataFrame:
    """A JSON column as a struct; what doesn't parse is null."""
    return df.withColumn(col, F.from_json(col, schema, {"mode": "PERMISSIVE"}))
