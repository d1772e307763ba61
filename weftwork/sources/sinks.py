"""Exports: column order, cells, JSON lines, JSON, CSV and XLSX."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import single_file

META = ("_url", "_page_url", "_fetched_at", "_tier")


def column_order(fields: Sequence[str], columns: Sequence[str], meta: bool = True, provenance: bool = False) -> list[str]:
    """Recipe fields, other columns as they come, then the implicit ones; provenance only on request."""
    plain = [f for f in fields if f in columns]
    others = [c for c in columns if c not in plain and not c.startswith("_")]
    tail = [c for c in META if c in columns] if meta else []
    return [*plain, *others, *tail, *(["_provenance"] if provenance and "_provenance" in columns else [])]


def cell(df: DataFrame, c: str) -> Column:
    """A cell as text: lists of scalars joined by '; ' (null as nothing), other nested values as JSON."""
    t = df.schema[c].dataType
    if isinstance(t, T.ArrayType) and not isinstance(t.elementType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), "; ", "")
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(F.col(c))
    return F.col(c).cast("string")


def cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[cell(df, c).alias(c) for c in columns])


def write_jsonl(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Keys in column order, only those that are there; one file per partition."""
    df.select(*columns).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    cells(df, columns).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def csv_file(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """One CSV file with a byte-order mark; tasks write its parts (write_csv leaves them apart)."""
    single_file.write(cells(df, columns), path, "csv")


def json_file(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """One indented JSON array; tasks write its parts (write_jsonl leaves lines in files of their own)."""
    single_file.write(df.select(F.to_json(F.struct(*columns)).alias("value")), path, "json")


def xlsx_file(df: DataFrame, path: str, columns: Sequence[str], sheet: str = "Items") -> None:
    """One workbook; numbers and truth values stay such, and what a sheet cannot hold goes on in the next."""
    plain = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType)
    shown = [F.col(c) if isinstance(df.schema[c].dataType, plain) else cell(df, c).alias(c) for c in columns]
    single_file.write(df.select(*shown), path, "xlsx", sheet=sheet)


def append_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tables whose columns only ever grow; what a row lacks is null."""
    return old.unionByName(new, allowMissingColumns=True)
