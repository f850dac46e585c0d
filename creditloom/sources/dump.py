"""Reading the metadata dump: COPY text, table discovery, staging rows, typed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import DUMP_TABLES, ID_COLUMNS, OPTIONAL_TEXT_COLUMNS, TEXT_COLUMNS, DumpTable

# Single-letter escapes of COPY text.
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", "v": "\x0b"}
MAX_U32 = 4294967295


def _octal_character(digits: Column) -> Column:
    """The character with the given octal code, up to 777."""
    code = F.conv(digits, 8, 10).cast("int")
    two_bytes = F.concat(
        F.hex(F.shiftright(code, 6).bitwiseOR(F.lit(192))), F.hex(code.bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128)))
    )
    return F.when(code < 128, F.char(code)).otherwise(F.decode(F.unhex(two_bytes), "UTF-8"))


def _escape(piece: Column) -> Column:
    """Text that followed one backslash, with the escape at its start resolved."""
    first = F.substring(piece, 1, 1)
    octal = F.regexp_extract(piece, "^[0-7]{1,3}", 0)
    out = F.when(octal != "", F.concat(_octal_character(octal), F.substr(piece, F.length(octal) + 1)))
    for letter, char in _ESCAPES.items():
        out = out.when(first == letter, F.concat(F.lit(char), F.substr(piece, F.lit(2))))
    return out.otherwise(piece)


def decode_copy_field(field: Column) -> Column:
    r"""One COPY field to text; ``\N`` is null, an empty field is empty text."""
    # Doubled backslashes split first, so every backslash left in a part starts an escape.
    parts = F.transform(
        F.split(field, r"\\\\", -1),
        lambda part: F.array_join(
            F.transform(F.split(part, r"\\", -1), lambda piece, i: F.when(i == 0, piece).otherwise(_escape(piece))),
            "",
        ),
    )
    decoded = F.when(field.contains("\\"), F.array_join(parts, "\\")).otherwise(field)
    return F.when(field == "\\N", F.lit(None).cast("string")).otherwise(decoded)


def has_trailing_escape(field: Column) -> Column:
    """True when the field ends in an odd run of backslashes."""
    return F.length(F.regexp_extract(field, r"(\\*)$", 1)) % 2 == 1


def copy_rows(lines: DataFrame, table: DumpTable, permissive: bool = False) -> DataFrame:
    """Project COPY lines (column ``value``) onto a table's columns.

    A short row or a trailing escape fails the job. ``permissive`` instead
    names the fault in a ``reject_reason`` column.
    """
    rows = lines.select(F.regexp_replace("value", "[\r\n]+$", "").alias("_line")).where("_line <> ''")
    rows = rows.select(F.split("_line", "\t", -1).alias("_fields"))
    short = F.size("_fields") < table.width
    broken = F.exists("_fields", has_trailing_escape)
    fault = F.when(broken, F.lit(f"table {table.name}: trailing escape")).when(
        short, F.lit(f"table {table.name}: a projected column is absent")
    )
    columns = [decode_copy_field(F.get("_fields", position)).alias(name) for name, position in table.columns]
    if permissive:
        return rows.select(*columns, fault.alias("reject_reason"))
    checked = rows.withColumn("_fields", F.when(fault.isNull(), F.col("_fields")).otherwise(F.raise_error(fault)))
    return checked.select(*columns)


def table_name(path: Column) -> Column:
    """File name less one known suffix."""
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"\.(bz2|gz|tsv|txt)$", "")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(name, path) of the dump tables under a folder; the least path wins."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return least_paths(files).where(F.col("name").isin(*DUMP_TABLES))


def least_paths(files: DataFrame) -> DataFrame:
    """(name, path): of the files that bear a table's name, the least path."""
    return files.select(table_name(F.col("path")).alias("name"), "path").groupBy("name").agg(F.min("path").alias("path"))


def read_dump(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All dump tables under a folder as nullable text columns."""
    # At most one row per known table reaches the driver.
    paths = {row["name"]: row["path"] for row in discover(spark, root).collect()}
    missing = [name for name, table in DUMP_TABLES.items() if table.required and name not in paths]
    if missing:
        raise ValueError(f"missing required tables: {', '.join(missing)}")
    return {
        name: copy_rows(spark.read.option("lineSep", "\n").text(path), DUMP_TABLES[name])
        for name, path in paths.items()
    }


def parse_json_rows(lines: DataFrame, table: DumpTable) -> DataFrame:
    """Lines (column ``value``) that each hold a JSON array of nullable strings."""
    cells = F.from_json("value", "array<string>", {"mode": "FAILFAST"})
    return lines.where(F.trim("value") != "").select(cells.alias("_cells")).select(
        *[F.get("_cells", i).alias(name) for i, (name, _) in enumerate(table.columns)]
    )


def read_json_rows(spark: SparkSession, path: str, table: DumpTable) -> DataFrame:
    return parse_json_rows(spark.read.text(path), table)


def with_defaults(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return rows.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()}) if defaults else rows


def parse_typed_json(lines: DataFrame, schema: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """JSON lines (column ``value``) with a fixed schema; absent fields take their default."""
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")
    return with_defaults(parsed, defaults or {})


def read_typed_json(spark: SparkSession, path: str, schema: str, defaults: dict[str, str] | None = None) -> DataFrame:
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return with_defaults(rows, defaults or {})


# What an evidence row means when it leaves these fields out.
EVIDENCE_DEFAULTS = {"scope": "recording", "relation_type": "instrument", "production_method": "performed"}


def required_text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def required_id(c: Column) -> Column:
    """A row number that fits 32 unsigned bits, or null."""
    number = F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("bigint"))
    return F.when(number.between(0, MAX_U32), number)


def typed_table(name: str, raw: DataFrame, permissive: bool = False) -> DataFrame:
    """Typed columns of a dump table; a bad required field fails or is named."""
    ids = ID_COLUMNS.get(name, ())
    texts = TEXT_COLUMNS.get(name, ())
    optional = OPTIONAL_TEXT_COLUMNS.get(name, ())
    values = {c: required_id(F.col(c)) for c in ids}
    values.update({c: required_text(F.col(c)) for c in texts + optional})
    out = raw.select(*[values.get(c, F.col(c)).alias(c) for c in raw.columns])
    required = [c for c in ids + texts]
    if not required:
        return out
    fault = F.coalesce(
        *[F.when(F.col(c).isNull(), F.lit(f"{name}.{c} is missing or not valid")) for c in required]
    )
    if permissive:
        return out.withColumn("reject_reason", fault)
    ok = fault.isNull()
    first = required[0]
    return out.withColumn(first, F.when(ok, F.col(first)).otherwise(F.raise_error(fault).cast(out.schema[first].dataType)))


def typed_tables(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: typed_table(name, df) for name, df in raw.items()}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
