"""Strings and citations of nested documents, by expressions made from the schema, or in a pass over JSON
text where there is none."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

_EMPTY = "CAST(array() AS array<struct<path:string,value:string>>)"


def _leaves(value: Column, kind: DataType, path: Column) -> Column | None:
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), F.array(F.struct(path.alias("path"), value.alias("value")))).otherwise(F.expr(_EMPTY))
    if isinstance(kind, StructType):
        parts = [_leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in sorted(kind.fields, key=lambda f: f.name)]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, ArrayType) and _leaves(F.lit(None), kind.elementType, F.lit("")) is not None:
        each = F.transform(value, lambda x, i: _leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(each), F.expr(_EMPTY))
    return None


def string_leaves(df: DataFrame, document: str, *keep: str) -> DataFrame:
    """A row for every string of a document with its path ($.findings[0].mechanism), fields in
    name order: keep..., path, value."""
    kind = df.schema[document].dataType
    found = _leaves(F.col(document), kind, F.lit("$"))
    return df.select(*keep, F.explode(found if found is not None else F.expr(_EMPTY)).alias("leaf")).select(*keep, "leaf.path", "leaf.value")


def _no_number(_: str) -> None:
    raise ValueError("NaN and Infinity are no JSON")


#: Numbers are not leaves, so how they are read does not matter; a float has no limit of digits.
_JSON = json.JSONDecoder(parse_int=float, parse_constant=_no_number)


def _strings(text: str, paths: list[str], values: list[str]) -> None:
    """Adds the paths and values of the strings of a JSON text; none if it is no JSON."""
    try:
        top = _JSON.decode(text)
    except (ValueError, RecursionError):
        return
    if type(top) is str:
        paths.append("$")
        values.append(top)
    todo = [("$", top)]
    while todo:
        path, v = todo.pop()
        if type(v) is dict:
            below = [(path + "." + k, x) for k, x in v.items()]
        elif type(v) is list:
            below = [(f"{path}[{i}]", x) for i, x in enumerate(v)]
        else:
            continue
        for at, x in below:
            if type(x) is str:
                paths.append(at)
                values.append(x)
            elif x and type(x) is not float:
                todo.append((at, x))


def _utf8(texts: list[str]) -> pa.Array:
    try:
        return pa.array(texts, pa.string())
    except UnicodeEncodeError:  # half of a surrogate pair, escaped
        return pa.array([x.encode("utf-8", "replace").decode() for x in texts], pa.string())


def open_leaves(df: DataFrame, document: str, *keep: str, levels: int | None = None) -> DataFrame:
    """P1 for open JSON text: the rows of string_leaves() to any depth, without a schema. A text that is no
    JSON has none, and a key stands as it is written (of repeated keys of an object the last counts).

    A document is parsed and gone down once, in one pass without a shuffle, so nothing depends on how many levels
    there are (`levels`, those of a pass, is not needed any more).
    """
    src = df.select(*keep, F.col(document).cast("string").alias("_document"))
    names = [*keep, "path", "value"]

    def made(batches):
        for b in batches:
            of, paths, values = [], [], []

            def rows():
                kept = b.select(list(range(b.num_columns - 1))).take(pa.array(of, pa.int32())).columns  # noqa: B023
                return pa.RecordBatch.from_arrays([*kept, _utf8(paths), _utf8(values)], names)  # noqa: B023

            for k, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if text is not None:
                    _strings(text, paths, values)
                    of += [k] * (len(paths) - len(of))
                if len(of) > 100_000:
                    yield rows()
                    of, paths, values = [], [], []
            if of:
                yield rows()

    schema = StructType([*src.schema.fields[:-1], StructField("path", StringType()), StructField("value", StringType())])
    return src.mapInArrow(made, schema)


def cited_files(leaves: DataFrame, *by: str) -> DataFrame:
    """The sorted distinct non-empty strings at a path that ends in .file."""
    some = leaves.where(F.endswith("path", F.lit(".file")) & (F.col("value") != ""))
    return some.groupBy(*by).agg(F.array_sort(F.collect_set("value")).alias("files"))


def citations(df: DataFrame, items: str, *keep: str) -> DataFrame:
    """P10: a row for every object of an array column that names a file: keep..., file, start_line,
    end_line, excerpt."""
    rows = df.select(*keep, F.explode(items).alias("c")).where("coalesce(c.file, '') <> ''")
    return rows.select(*keep, "c.file", "c.start_line", "c.end_line", "c.excerpt")
