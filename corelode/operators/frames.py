"""Column and row operators on plain tables: casts, filters, rules, classes and their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")
# Texts that stand for a missing number.
MISSING = ("", "NA", "N/A", "-")


def rename_to_standard(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns renamed by ``mapping`` (standard name to own name); own names that are absent are passed over."""
    return df.withColumnsRenamed({own: name for name, own in mapping.items() if own in df.columns})


def negate(df: DataFrame, column: str) -> DataFrame:
    """A dip that is given downwards as positive, turned."""
    return df.withColumn(column, -F.col(column))


def as_number(text: Column) -> Column:
    """The number that a text starts with once < > , % $ are off; null for missing or unreadable texts."""
    clean = F.trim(F.regexp_replace(text, r"[<>,%$]", ""))
    head = F.regexp_extract(clean, r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1)
    return F.when(~text.isin(*MISSING) & (head != ""), head.cast("double"))


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every one of the columns has a finite value.

    NaN sorts above all numbers, so one comparison is enough: a filter on a long expression works it out once.
    """
    for c in columns:
        df = df.where(F.abs(F.col(c).cast("double")) < float("inf"))
    return df


def cast_column(df: DataFrame, column: str, kind: str, negative_as_zero: bool = True) -> DataFrame:
    """``column`` as numeric, float, integer, text or categorical; missing numbers stay null, missing texts become empty.

    Negative numbers become 0 where asked; integers are rounded half up, null beyond the range of a long.
    """
    c = F.col(column)
    if kind in ("text", "categorical"):
        return df.withColumn(column, F.coalesce(c.cast("string"), F.lit("")))
    number = c.cast("double") if dict(df.dtypes)[column] in NUMERIC else as_number(c.cast("string"))
    if negative_as_zero:
        number = F.when(number < 0, 0.0).otherwise(number)
    if kind == "integer":
        # What a long cannot hold is missing.
        number = F.when(F.abs(number) < 2.0**63, F.floor(number + 0.5).cast("long"))
    return df.withColumn(column, number)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold nothing but nulls and blank texts."""
    text = {c for c, t in df.dtypes if t == "string"}
    held = lambda c: F.nullif(F.trim(c), F.lit("")) if c in text else F.col(c)
    counts = df.agg(*[F.count(held(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c]])


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Those of ``wanted`` that the table lacks, in any case."""
    own = {c.lower() for c in df.columns}
    return [c for c in wanted if c.lower() not in own]


def zero_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers only: null, NaN and infinite cells become 0."""
    number = lambda c: F.col(c).cast("double")
    fine = lambda c: number(c).isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) != float("inf"))
    return df.withColumns({c: F.when(fine(c), number(c)).otherwise(0.0) for c in columns})


def log_positive(df: DataFrame, column: str, name: str) -> DataFrame:
    """``name`` is log10 of the column; rows whose value is not positive are left out."""
    return df.where(F.col(column) > 0).withColumn(name, F.log10(F.col(column).cast("double")))


def hole_rows(df: DataFrame, hole: str, value: str, depth: str) -> DataFrame:
    """One hole's rows by depth."""
    return df.where(F.col(hole) == value).orderBy(depth)


def value_filter(df: DataFrame, column: str, low: float | None = None, high: float | None = None, values: list[str] | None = None) -> DataFrame:
    """Rows within closed bounds or of the listed values; a null passes no filter."""
    keep = F.col(column).isNotNull()
    if low is not None:
        keep = keep & (F.col(column) >= low)
    if high is not None:
        keep = keep & (F.col(column) <= high)
    if values is not None:
        keep = keep & F.col(column).cast("string").isin(*values)
    return df.where(keep)


def rule_match(df: DataFrame, column: str, rules: list[dict], name: str = "rule", default: str | None = None) -> DataFrame:
    """The name of the first rule that matches: {"name", "min", "max"} closed at both ends, or {"name", "value"} by text."""
    c, out = F.col(column), None
    number = c.cast("double") if dict(df.dtypes)[column] in NUMERIC else as_number(c.cast("string"))
    for r in rules:
        hit = number.between(r["min"], r["max"]) if "min" in r else c.cast("string") == r["value"]
        out = F.when(hit, r["name"]) if out is None else out.when(hit, r["name"])
    return df.withColumn(name, out.otherwise(default) if out is not None else F.lit(default))


def visible(df: DataFrame, tabs: list[tuple[str, list[dict]]], name: str = "visible") -> DataFrame:
    """Whether a row's matching rule is visible ({"visible": bool} in each rule, true if unsaid) on every tab (column, rules); no match hides nothing."""
    shown = df.withColumn(name, F.lit(True))
    for column, rules in tabs:
        shown = rule_match(shown, column, rules, "__rule")
        hidden = [r["name"] for r in rules if not r.get("visible", True)]
        shown = shown.withColumn(name, F.col(name) & ~F.coalesce(F.col("__rule").isin(*hidden), F.lit(False))).drop("__rule")
    return shown


def crossed(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """One category from several: their texts that are neither null nor empty, joined by " + "; null where there is none."""
    texts = F.filter(F.array(*[F.col(c).cast("string") for c in columns]), lambda v: v.isNotNull() & ~v.isin("", "null", "undefined"))
    return df.withColumn(name, F.when(F.size(texts) > 0, F.array_join(texts, " + ")))


def assign_class(df: DataFrame, key: str, chosen: DataFrame, column: str, label: str) -> DataFrame:
    """``column`` becomes ``label`` in rows whose key is in ``chosen``; others keep theirs (null where the column is new)."""
    own = F.col(column) if column in df.columns else F.lit(None).cast("string")
    hit = chosen.select(F.col(key).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    both = df.join(hit, F.col(key) == F.col("__key"), "left").withColumn(column, F.when(F.col("__hit"), label).otherwise(own))
    return both.drop("__key", "__hit")


def painted(df: DataFrame, key: str, strokes: DataFrame, name: str) -> DataFrame:
    """Each row with the group of its latest stroke (key, seq, group; a null group unpaints)."""
    last = strokes.groupBy(F.col(key).alias("__key")).agg(F.max_by("group", "seq").alias(name))
    return df.join(last, F.col(key) == F.col("__key"), "left").drop("__key")


def merge_classes(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The first class of several columns that is neither null nor empty."""
    return df.withColumn(name, F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns]))


def class_counts(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """(class, n) of a number by rising bounds, half-open; a value beyond the ends goes to the nearest class, null to none."""
    at = sum((F.when(F.col(column) >= b, 1).otherwise(0) for b in bounds[1:-1]), F.lit(0))
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("class")).agg(F.count("*").alias("n"))


def field_values(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the column's distinct values."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def field_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, min, max, mean, sum, n) of number columns."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r")).select("r.*")
    return cells.groupBy("name").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.sum("v").alias("sum"), F.count("v").alias("n"))


def placed(df: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    """Rows that have coordinates; a missing height is 0."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.withColumn(z, F.coalesce(F.col(z), F.lit(0.0))) if z else rows
