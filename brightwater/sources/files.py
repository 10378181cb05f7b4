"""Files in and out: CSV, COPY text, tagged documents, dumps."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_table(spark: SparkSession, path: str, header: bool = True, schema: str | None = None, columns: int | None = None) -> DataFrame:
    """A CSV file as a table of text columns, or with a schema; without a header columns are c0, c1 and on."""
    if schema is None and columns is not None:
        schema = ", ".join(f"c{i} string" for i in range(columns))
    reader = spark.read.option("header", header).option("escape", '"').option("multiLine", False)
    frame = (reader.schema(schema) if schema else reader).csv(path)
    return frame if schema or header else frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with what orders them within their file: the block's place, and the line's in the block."""
    lines = spark.read.text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")).alias("place"))


def import_csv(spark: SparkSession, path: str, schema: str, skip: int = 0) -> DataFrame:
    """`.import --csv --skip N`: the first N lines of each file are passed over."""
    lines = _numbered(spark, path)
    if skip:
        # the Nth smallest place of a file bounds what is passed over
        first = lines.where(F.col("place.at") == 0).groupBy("file").agg(F.array_max(F.slice(F.array_sort(F.collect_list("place")), 1, skip)).alias("last")) if skip > 1 else lines.groupBy("file").agg(F.min("place").alias("last"))
        lines = lines.join(F.broadcast(first), "file").where("place > last")  # a row a file
    fields = T.StructType.fromDDL(schema)
    return lines.select(F.from_csv("value", fields.simpleString()[7:-1].replace(":", " "), {"escape": '"'}).alias("r")).select("r.*")


#: Escapes of COPY's text format (fixed values).
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def copy_text(spark: SparkSession, path: str, schema: str, delimiter: str = "\t", null: str = "\\N", header: bool = False) -> DataFrame:
    """COPY ... FROM in text format: backslash escapes, a null string, and `\\.` as the end of the data."""
    lines = _numbered(spark, path)
    ends = lines.where(F.col("value") == "\\.").groupBy("file").agg(F.min("place").alias("last"))
    lines = lines.join(F.broadcast(ends), "file", "left").where("last IS NULL OR place < last")  # a row a file
    if header:
        heads = lines.groupBy("file").agg(F.min("place").alias("head"))
        lines = lines.join(F.broadcast(heads), "file").where("place > head")
    fields = T.StructType.fromDDL(schema).fields
    # a delimiter after an odd number of backslashes belongs to the field
    parts = F.split("value", r"(?<=(?<!\\)(?:\\\\){0,50})" + "\\Q" + delimiter + "\\E", -1)

    def plain(x: Column) -> Column:
        held = F.replace(x, F.lit("\\\\"), F.lit("\x00"))
        for code, character in _ESCAPES.items():
            held = F.replace(held, F.lit("\\" + code), F.lit(character))
        return F.replace(F.replace(held, F.lit("\\"), F.lit("")), F.lit("\x00"), F.lit("\\"))

    rows = lines.select(parts.alias("p"))
    value = lambda i: F.when(F.get("p", F.lit(i)) != null, plain(F.get("p", F.lit(i))))
    return rows.select(*[value(i).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def copy_lines(df: DataFrame, delimiter: str = "\t", null: str = "\\N") -> DataFrame:
    """Rows as lines of COPY's text format (column value)."""
    out = []
    for c in df.columns:
        text = F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\"))
        for code, character in _ESCAPES.items():
            text = F.replace(text, F.lit(character), F.lit("\\" + code))
        out.append(F.coalesce(F.replace(text, F.lit(delimiter), F.lit("\\" + delimiter)) if delimiter != "\t" else text, F.lit(null)))
    return df.select(F.concat_ws(delimiter, *out).alias("value"))


def tagged(value: Column, kind: T.DataType) -> Column:
    """A value as a tagged JSON text: {"type": ..., "value": ...}."""

    def tag(name: str, text: Column) -> Column:
        return F.concat(F.lit(f'{{"type":"{name}","value":'), text, F.lit("}"))

    if isinstance(kind, T.StructType):
        inner = [F.concat(F.lit(json.dumps(f.name) + ":"), tagged(value[f.name], f.dataType)) for f in kind.fields]
        out = tag("Object", F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}")))
    elif isinstance(kind, T.ArrayType):
        out = tag("Array", F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: tagged(x, kind.elementType)), ","), F.lit("]")))
    elif isinstance(kind, T.BooleanType):
        out = tag("Boolean", value.cast("string"))
    elif isinstance(kind, T.IntegralType):
        out = tag("Integer", F.concat(F.lit('"'), value.cast("string"), F.lit('"')))
    elif isinstance(kind, T.StringType):
        quoted = F.to_json(F.array(value))
        out = tag("String", F.substr(quoted, F.lit(2), F.length(quoted) - 2))
    elif isinstance(kind, T.FractionalType):
        out = tag("Number", F.concat(F.lit('"'), _bits(value.cast("double")), F.lit('"')))
    else:
        raise ValueError(f"no tag for {kind.simpleString()}")
    return F.when(value.isNull(), F.lit('{"type":"Null"}')).otherwise(out)


def _arrow(kind: str, function: Callable):
    import pandas as pd

    return F.pandas_udf(lambda x: pd.Series([None if v is None or v != v else function(v) for v in x]), kind)


def _bits(value: Column) -> Column:
    """The 64 bits of a double as hexadecimal text."""
    return _arrow("string", lambda v: struct.pack(">d", v).hex())(value)


def untagged(text: Column) -> Column:
    """The plain JSON of a tagged text."""

    def plain(node):
        kind, value = node["type"], node.get("value")
        if kind == "Object":
            return {k: plain(v) for k, v in value.items()}
        if kind == "Array":
            return [plain(v) for v in value]
        if kind == "Integer":
            return int(value)
        if kind == "Number":
            return struct.unpack(">d", bytes.fromhex(value))[0]
        if kind == "Record":
            return f"{value['table']}:{value['key']['value']}"
        if kind in ("Null", "Boolean", "String", "Binary", "Vector"):
            return value
        raise ValueError(f"unknown tag {kind}")

    return _arrow("string", lambda t: json.dumps(plain(json.loads(t)), separators=(",", ":"), ensure_ascii=False))(text)


#: The header line of tagged NDJSON.
HEADER = json.dumps({"header": {"format": "documents", "version": 1}}, separators=(",", ":"))


def read_tagged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of tagged NDJSON, by a schema; the header line is passed over."""
    lines = spark.read.text(path).where(~F.col("value").startswith('{"header":'))
    return lines.select(F.from_json(untagged(F.col("value")), schema).alias("d")).select("d.*")


def literal(column: Column, kind: T.DataType) -> Column:
    """A value as an SQL literal."""
    if isinstance(kind, (T.IntegralType, T.FractionalType, T.BooleanType)):
        return F.coalesce(column.cast("string"), F.lit("NULL"))
    return F.coalesce(F.concat(F.lit("'"), F.replace(column.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def dump(df: DataFrame, name: str) -> DataFrame:
    """`.dump`: an INSERT statement a row (column value)."""
    return df.select(F.concat(F.lit(f"INSERT INTO {name} VALUES("), F.concat_ws(",", *[literal(F.col(f.name), f.dataType) for f in df.schema.fields]), F.lit(");")).alias("value"))


def listed(df: DataFrame, separator: str = "|") -> DataFrame:
    """`.mode list`: a line a row, nulls empty (column value)."""
    return df.select(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))
