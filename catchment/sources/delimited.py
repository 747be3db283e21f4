"""Delimited text with its dialect found out, imports by format, kinds of user tables, decision tables."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file's head that the dialect is found out from.
HEAD = 8192
#: Columns of the kinds of user tables.
KINDS = {
    "landuse": "LANDUSE_ID int, CODE string",
    "soil": "SOIL_ID int, SNAM string",
    "urban": "id int, name string, description string, frac_imp double, frac_dc_imp double, curb_den double, urb_wash double, dirt_max double, t_halfmax double, conc_totn double, conc_totp double, conc_no3n double, urb_cn double",
}


def dialect(spark: SparkSession, path: str) -> tuple[str, bool, list[str]]:
    """Delimiter of a file, whether it looks as if it had a header, and its first line, from its first ``HEAD`` bytes.

    A file in which no delimiter shows, as one of a single column, is taken for one with commas; an empty one has no columns and no header.
    """
    head = spark.read.format("binaryFile").load(path).where("length > 0").select(F.substring(F.col("content"), 1, HEAD).cast("string").alias("t")).first()
    text = head["t"] if head else ""
    if len(text.encode()) >= HEAD:
        text = text[: text.rfind("\n")]
    if not text.strip():
        return ",", False, []
    try:
        found = csv.Sniffer().sniff(text, delimiters=",;\t|")
    except csv.Error:
        found = csv.excel
    try:
        headed = csv.Sniffer().has_header(text)
    except csv.Error:
        headed = False
    return found.delimiter, headed, next(csv.reader(text.splitlines(), found), [])


def _is_header(first: list[str], schema: T.StructType) -> bool:
    """Whether a first line has words where the schema has numbers."""

    def number(x: str) -> bool:
        try:
            float(x.replace(",", ".", 1))
        except ValueError:
            return x.strip() in ("", "null")
        return True

    return any(isinstance(f.dataType, T.NumericType) and not number(x) for x, f in zip(first, schema.fields))


def _value(token: Column, kind: T.DataType, comma: bool) -> Column:
    """A token as a value: the word null and what can't be read are null; a first decimal comma is a point."""
    clean = F.nullif(F.trim(token), F.lit("null"))
    if isinstance(kind, T.StringType):
        return clean
    return (F.regexp_replace(clean, "^([^,]*),", "$1.") if comma else clean).try_cast(kind)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str | None = None, header: bool | None = None, lower_names: bool = False) -> DataFrame:
    """Rows of delimited files by position; a line with other columns than the first, or too few for ``schema``, is an error.

    Delimiter and header are found out from the first file, unless given; a line with words in columns
    of numbers is a header, too. With another delimiter than
    a comma, a first decimal comma in a number is a point. Columns beyond the schema's are dropped.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    found, headed, first = dialect(spark, path)
    delimiter, header = delimiter or found, headed or _is_header(first, schema) if header is None else header
    columns = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(max(len(first), len(schema.fields)))])
    rows = spark.read.csv(path, sep=delimiter, header=header, schema=columns, enforceSchema=True, mode="FAILFAST")
    return rows.select(*_columns(F.array(*columns.names), schema, delimiter != ",", lower_names))


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str, start: int = 3, delimiter: str | None = None, lower_names: bool = False) -> DataFrame:
    """Rows of text files from line ``start`` on, parted by white space or by ``delimiter``; blank lines are skipped.

    A line with fewer columns than ``schema`` is an error; further ones are dropped.
    """
    from catchment.sources.text import lines

    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = lines(spark, path).where((F.col("line") >= start) & (F.trim("value") != ""))
    tokens = F.split(F.trim("value"), r"\s+" if delimiter is None else "[" + delimiter + "]")
    short = F.raise_error(F.concat(F.lit(f"a line has fewer than {len(schema.fields)} columns: "), F.col("value")))
    rows = rows.select(F.when(F.size(tokens) < len(schema.fields), short.cast("array<string>")).otherwise(tokens).alias("t"))
    return rows.select(*_columns(F.col("t"), schema, False, lower_names))


def _columns(tokens: Column, schema: T.StructType, comma: bool, lower_names: bool) -> list[Column]:
    out = []
    for k, f in enumerate(schema.fields):
        x = _value(F.get(tokens, F.lit(k)), f.dataType, comma)
        out.append((F.lower(x) if lower_names and f.name == "name" else x).alias(f.name))
    return out


def import_kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A user table of one of the ``KINDS``; a land-use file with a third column has descriptions, too."""
    schema = T._parse_datatype_string(KINDS[kind])
    if kind == "landuse" and len(dialect(spark, path)[2]) == 3:
        schema = schema.add("DESCRIPTION", T.StringType())
    return read_delimited(spark, path, schema)


def thaw(table: DataFrame, new: DataFrame, strict: bool) -> DataFrame:
    """``table`` with the rows of ``new``: strictly, unknown columns are dropped; else the table gets them, null in old rows.

    New values are cast to the types of the table's columns; columns that ``new`` lacks are null.
    """
    known = {f.name: f.dataType for f in table.schema}
    picked = [F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c) for c in new.columns if c in known or not strict]
    return table.unionByName(new.select(*picked), allowMissingColumns=True)


def add_rows(table: DataFrame, rows: DataFrame, overwrite: str = "ignore") -> DataFrame:
    """``table`` with ``rows``; what becomes of those whose name it has already is told by ``overwrite``.

    ``ignore``: they are added all the same. ``replace``: they take the place of the old rows; of
    several new ones with one such name the greatest. ``rename``: they are added with the first number
    from 1 behind their name that makes a name which the table hasn't. Null names are new.
    """
    if overwrite == "ignore":
        return table.unionByName(rows)
    names = table.where("name is not null").select("name").distinct()
    old, new = rows.join(names, "name", "left_semi").select(table.columns), rows.join(names, "name", "left_anti").select(table.columns)
    if overwrite == "replace":
        best = old.groupBy("name").agg(F.max(F.struct(*table.columns)).alias("r")).select("r.*")
        return table.join(best, "name", "left_anti").select(table.columns).unionByName(best).unionByName(new)
    if overwrite != "rename":
        raise ValueError(f"no such way: {overwrite}")
    # Each way to read a name as another with a number behind it.
    digits = F.length(F.regexp_extract("name", r"(\d*)$", 1))
    ends = F.explode(F.when(digits > 0, F.sequence(F.lit(1), digits)))
    split = names.withColumn("n", ends).select(F.expr("substring(name, 1, length(name) - n)").alias("name"), F.expr("right(name, n)").alias("k")).where("k not like '0%'")
    used = split.groupBy("name").agg(F.collect_set(F.col("k").try_cast("long")).alias("used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1).cast("long"), F.size(F.coalesce("used", F.array().cast("array<long>"))) + 1), F.coalesce("used", F.array().cast("array<long>"))))
    renamed = old.join(used, "name", "left").withColumn("name", F.concat("name", free.cast("string"))).select(table.columns)
    return table.unionByName(new).unionByName(renamed)


FORMATS = ("csv", "tsv", "json")


def import_format(spark: SparkSession, path: str, kind: str, table: DataFrame, strict: bool = False) -> DataFrame:
    """``table`` with the rows of a file in one of the ``FORMATS``, its columns by name."""
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}; there are {', '.join(FORMATS)}")
    new = spark.read.json(path) if kind == "json" else spark.read.csv(path, header=True, sep={"csv": ",", "tsv": "\t"}[kind])
    return thaw(table, new, strict)


def decision_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conditions, their alternatives, and actions with outcomes, of decision-table files as lines (path, line, value).

    Lines 1 and 2 are a title and a count. A table is a header line, a line with its name and the
    numbers of conditions, alternatives and actions, a header and the conditions, a header and the
    actions; blank lines part tables. Conditions: path, table, cond, var, obj, obj_num, lim_var,
    lim_op, lim_const, alts. Actions: path, table, act, act_typ, obj, obj_num, name, option, const,
    const2, fp, outcomes (true for y).
    """
    body = rows.where((F.col("line") > 2) & (F.trim("value") != "")).select("path", "line", F.split(F.trim(F.split("value", "!")[0]), r"\s+").alias("t"))
    w = Window.partitionBy("path").orderBy("line")
    # A header that begins with name, conds, alts starts a table; the line after it has the numbers.
    starts = (F.lower(F.get("t", F.lit(1))) == "conds") & (F.lower(F.get("t", F.lit(2))) == "alts")
    body = body.withColumn("table_no", F.sum(starts.cast("int")).over(w)).where("table_no > 0")
    own = Window.partitionBy("path", "table_no").orderBy("line")
    body = body.withColumn("at", F.row_number().over(own))
    head = body.where("at = 2").select("path", "table_no", F.get("t", F.lit(0)).alias("table"), *[F.get("t", F.lit(k)).cast("int").alias(n) for k, n in ((1, "conds"), (2, "alts"), (3, "acts"))])
    body = body.join(head, ["path", "table_no"])
    token = lambda k: F.get("t", F.lit(k))
    conds = body.where("at > 3 and at <= 3 + conds").select(
        "path", "table", (F.col("at") - 3).alias("cond"), token(0).alias("var"), token(1).alias("obj"), token(2).cast("int").alias("obj_num"), token(3).alias("lim_var"), token(4).alias("lim_op"), token(5).cast("double").alias("lim_const"), F.slice("t", F.lit(7), F.col("alts")).alias("alts")
    )
    acts = body.where("at > 4 + conds and at <= 4 + conds + acts").select(
        "path", "table", (F.col("at") - 4 - F.col("conds")).alias("act"), token(0).alias("act_typ"), token(1).alias("obj"), token(2).cast("int").alias("obj_num"), token(3).alias("name"), token(4).alias("option"), token(5).alias("const"), token(6).alias("const2"), token(7).alias("fp"),
        F.transform(F.slice("t", F.lit(9), F.greatest(F.size("t") - 8, F.lit(0))), lambda x: x == "y").alias("outcomes"),
    )
    alts = conds.select("path", "table", "cond", F.posexplode("alts").alias("alt", "value")).withColumn("alt", F.col("alt") + 1)
    return conds.drop("alts"), alts, acts
