"""Deposit vectoring: indicators from element columns, fertility bands, summaries and a ranking of deposit types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category of each indicator and its bands in the order tested, first match wins: sign, bound (both ends of ``between`` are in), fertility.
INDICATORS = {
    "sr-y": ("fertility", (("<", 20, "low"), ("between", (20, 40), "moderate"), ("between", (40, 100), "high"), (">", 100, "very-high"))),
    "v-sc": ("fertility", (("<", 10, "low"), ("between", (10, 20), "moderate"), (">", 20, "high"))),
    "eu-anomaly": ("fertility", (("<", 0.6, "low"), ("between", (0.6, 0.8), "moderate"), ("between", (0.8, 1), "high"), (">", 1, "high"))),
    "k-na": ("alteration", (("<", 0.5, "low"), ("between", (0.5, 1.5), "moderate"), (">", 1.5, "high"))),
    "ni-cr": ("fertility", (("<", 0.5, "barren"), ("between", (0.5, 1), "moderate"), (">", 1, "high"))),
    "kambalda-ratio": ("fertility", (("<", 0.5, "barren"), ("between", (0.5, 1), "low"), (">=", 1, "high"))),
    "mg-number": ("fractionation", ()),
    "carlin-as": ("pathfinder", (("<", 20, "barren"), ("between", (20, 100), "low"), ("between", (100, 500), "moderate"), (">", 500, "high"))),
    "carlin-sb": ("pathfinder", (("<", 1, "barren"), ("between", (1, 5), "low"), ("between", (5, 20), "moderate"), (">", 20, "high"))),
    "carlin-hg": ("pathfinder", (("<", 0.1, "barren"), ("between", (0.1, 1), "low"), (">", 1, "moderate"))),
    "carlin-tl": ("pathfinder", (("<", 1, "barren"), ("between", (1, 5), "moderate"), (">", 5, "high"))),
    "k-rb": ("fractionation", (("<", 10, "very-high"), ("between", (10, 30), "high"), ("between", (30, 100), "moderate"), ("between", (100, 200), "low"), (">", 200, "barren"))),
    "nb-ta": ("fractionation", (("<", 5, "high"), ("between", (5, 8), "moderate"), ("between", (8, 15), "low"), (">", 15, "barren"))),
    "zr-hf": ("fractionation", (("<", 15, "high"), ("between", (15, 30), "moderate"), (">", 30, "low"))),
    "mg-li": ("fertility", (("<", 5, "high"), ("between", (5, 10), "moderate"), (">", 10, "low"))),
    "sedex-metal-index": ("proximity", (("<", 500, "barren"), ("between", (500, 2000), "low"), ("between", (2000, 10000), "moderate"), (">", 10000, "high"))),
    "sedex-alteration-index": ("alteration", (("<", 20, "barren"), ("between", (20, 50), "low"), ("between", (50, 80), "moderate"), (">", 80, "high"))),
    "u-se-relation": ("proximity", (("<", 1, "low"), ("between", (1, 10), "high"), (">", 10, "very-high"))),
    "u-mo-relation": ("proximity", (("<", 2, "low"), ("between", (2, 10), "moderate"), (">", 10, "moderate"))),
    "au-bi": ("proximity", (("<", 0.1, "high"), ("between", (0.1, 1), "moderate"), (">", 1, "low"))),
    "bi-te-signature": ("pathfinder", (("<", 1, "barren"), ("between", (1, 10), "low"), (">", 10, "high"))),
    "au-ag": ("fertility", (("<", 1, "low"), ("between", (1, 5), "moderate"), (">", 5, "high"))),
    "three-k-al": ("alteration", (("<", 0.1, "low"), ("between", (0.1, 0.25), "moderate"), ("between", (0.25, 0.4), "high"), (">", 0.4, "moderate"))),
    "na-al": ("alteration", (("<", 0.3, "high"), ("between", (0.3, 0.6), "moderate"), (">", 0.6, "low"))),
    "co-ni": ("fertility", (("<", 0.1, "low"), ("between", (0.1, 0.5), "moderate"), (">", 0.5, "high"))),
    "pd-cu": ("fertility", (("<", 0.1, "low"), ("between", (0.1, 1), "moderate"), (">", 1, "high"))),
    "th-yb": ("fertility", (("<", 0.5, "low"), ("between", (0.5, 2), "moderate"), (">", 2, "high"))),
    "ba-sr": ("proximity", (("<", 1, "high"), ("between", (1, 5), "moderate"), (">", 5, "low"))),
    "alteration-index": ("alteration", (("<", 35, "low"), ("between", (35, 65), "moderate"), (">", 65, "high"))),
    "ccpi": ("alteration", ()),
    "sn-content": ("pathfinder", (("<", 5, "barren"), ("between", (5, 50), "moderate"), ("between", (50, 500), "high"), (">", 500, "very-high"))),
    "w-content": ("pathfinder", (("<", 2, "barren"), ("between", (2, 20), "moderate"), ("between", (20, 200), "high"), (">", 200, "very-high"))),
}
# Indicators of each deposit type.
DEPOSITS = {
    "porphyry-cu-au": ("sr-y", "v-sc", "eu-anomaly", "k-na", "alteration-index", "three-k-al"),
    "komatiite-ni": ("ni-cr", "kambalda-ratio", "mg-number", "th-yb"),
    "carlin-gold": ("carlin-as", "carlin-sb", "carlin-hg", "carlin-tl"),
    "irgs": ("au-bi", "bi-te-signature"),
    "lct-pegmatite": ("k-rb", "nb-ta", "zr-hf", "mg-li"),
    "sedex": ("sedex-metal-index", "sedex-alteration-index", "carlin-tl"),
    "uranium-rollfront": ("u-se-relation", "u-mo-relation"),
    "orogenic-gold": ("au-ag", "three-k-al", "carlin-as", "carlin-sb"),
    "vms": ("eu-anomaly", "ba-sr", "alteration-index", "ccpi"),
    "iocg": ("na-al", "k-na", "co-ni"),
    "ni-cu-pge-intrusion": ("pd-cu", "th-yb", "mg-number"),
    "sn-w-greisen": ("sn-content", "w-content", "k-rb", "zr-hf"),
    "porphyry-cu-mo": ("sr-y", "v-sc", "eu-anomaly", "k-na", "alteration-index"),
    "epithermal-hs": ("alteration-index", "k-na", "carlin-as"),
    "epithermal-ls": ("au-ag", "k-na", "carlin-hg", "carlin-sb"),
    "skarn": ("alteration-index", "k-na", "eu-anomaly"),
    "mvt": ("carlin-tl", "sedex-alteration-index"),
    "carbonatite-ree": ("eu-anomaly", "nb-ta"),
}
#: Indicators that are one element's content, and their element.
CONTENT = {"carlin-as": "As", "carlin-sb": "Sb", "carlin-hg": "Hg", "carlin-tl": "Tl", "sn-content": "Sn", "w-content": "W"}
#: Elements that a special formula needs.
SPECIAL = {
    "eu-anomaly": ("Eu", "Sm", "Gd"), "kambalda-ratio": ("Ni", "Cr", "Cu", "Zn"), "sedex-metal-index": ("Zn", "Pb"), "sedex-alteration-index": ("Fe", "Mn", "Mg"),
    "three-k-al": ("K", "Al"), "alteration-index": ("K", "Mg", "Na", "Ca"), "ccpi": ("Mg", "Fe", "Na", "K"), "mg-number": ("Mg", "Fe"),
    "bi-te-signature": ("Bi", "Te"), "k-rb": ("K", "Rb"), "u-se-relation": ("U", "Se"), "u-mo-relation": ("U", "Mo"),
}


def elements_of(indicator: str) -> tuple[str, ...]:
    """The elements that an indicator cannot do without."""
    if indicator in CONTENT:
        return (CONTENT[indicator],)
    return SPECIAL.get(indicator) or tuple(e.capitalize() for e in indicator.split("-"))


def indicator(name: str, columns: dict[str, str]) -> Column:
    """An indicator's value; ``columns`` names the column of each element.  Null where an element is missing or a divisor is 0."""
    e = {k: F.col(c).cast("double") for k, c in columns.items()}
    if name in CONTENT:
        return e[CONTENT[name]]
    if name == "eu-anomaly":
        sm, gd = e["Sm"] / 0.148, e["Gd"] / 0.199
        return F.when((sm > 0) & (gd > 0), e["Eu"] / 0.0563 / F.sqrt(sm * gd))
    if name == "kambalda-ratio":
        return F.try_divide(e["Ni"], e["Cr"]) * F.try_divide(e["Cu"], e["Zn"])
    if name == "sedex-metal-index":
        return e["Zn"] + 100 * e["Pb"] + (F.coalesce(100 * e["Tl"], F.lit(0.0)) if "Tl" in e else 0.0)
    if name == "sedex-alteration-index":
        iron = e["Fe"] + 10 * e["Mn"]
        return F.try_divide(100 * iron, iron + e["Mg"])
    if name == "three-k-al":
        return 3 * F.try_divide(e["K"] / 94.2, e["Al"] / 101.96)
    if name == "alteration-index":
        return F.try_divide(100 * (e["K"] + e["Mg"]), e["K"] + e["Mg"] + e["Na"] + e["Ca"])
    if name == "ccpi":
        return F.try_divide(100 * (e["Mg"] + e["Fe"]), e["Mg"] + e["Fe"] + e["Na"] + e["K"])
    if name == "mg-number":
        return F.try_divide(100 * e["Mg"], e["Mg"] + e["Fe"])
    if name == "bi-te-signature":
        return e["Bi"] + e["Te"]
    if name == "k-rb":
        return F.try_divide(e["K"] * 10_000, e["Rb"])
    over, under = elements_of(name)
    return F.try_divide(e[over], e[under])


def fertility(value: Column, name: str) -> Column:
    """The label of the first band that holds a value; null for none."""
    out = F.when(value.isNull(), None)
    for sign, bound, label in INDICATORS[name][1]:
        if sign == "between":
            hit = value.between(float(bound[0]), float(bound[1]))
        else:
            hit = {"<": value < bound, ">": value > bound, ">=": value >= bound}[sign]
        out = out.when(hit, label)
    return out


def known(columns: dict[str, str]) -> list[str]:
    """Indicators all of whose elements have a column."""
    return [i for i in INDICATORS if all(e in columns for e in elements_of(i))]


def missing_elements(columns: dict[str, str]) -> dict[str, list[str]]:
    """For each indicator that cannot be built the elements without a column."""
    return {i: gone for i in INDICATORS if (gone := [e for e in elements_of(i) if e not in columns])}


def indicators(df: DataFrame, key: list[str], columns: dict[str, str]) -> DataFrame:
    """(key, indicator, value, fertility) of every row and every indicator that can be built."""
    cells = []
    for i in known(columns):
        cells.append(F.struct(F.lit(i).alias("indicator"), indicator(i, columns).alias("value"), fertility(indicator(i, columns), i).alias("fertility")))
    return df.select(*key, F.explode(F.array(*cells)).alias("r")).select(*key, "r.*")


def indicator_summary(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(indicator, n, min, max, mean, std, barren, low, moderate, high, very_high) with population deviation."""
    label = lambda s: F.count(F.when(F.col("fertility") == s, 1))
    v = F.col("value")
    return indicators(df, [], columns).groupBy("indicator").agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        label("barren").alias("barren"), label("low").alias("low"), label("moderate").alias("moderate"), label("high").alias("high"), label("very-high").alias("very_high"),
    )


def deposit_ranking(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(deposit, indicators, positive, score): the mean share of fertile rows over a type's indicators, very high 3, high 2, moderate 1 of 3.

    Indicators of category fertility count twice; one is positive where more than a tenth of its values are high or very high.
    """
    spark = df.sparkSession
    uses = [(d, i, 2.0 if INDICATORS[i][0] == "fertility" else 1.0) for d, names in DEPOSITS.items() for i in names if i in known(columns)]
    named = spark.createDataFrame(uses, "deposit string, indicator string, weight double")
    found = indicator_summary(df, columns).where("n > 0")
    own = 100 * (3 * F.col("very_high") + 2 * F.col("high") + F.col("moderate")) / (3 * F.col("n"))
    both = named.join(found, "indicator").withColumn("own", own).withColumn("positive", (F.col("high") + F.col("very_high") > 0.1 * F.col("n")).cast("int"))
    return both.groupBy("deposit").agg(F.count("*").alias("indicators"), F.sum("positive").alias("positive"), (F.sum(F.col("own") * F.col("weight")) / F.sum("weight")).alias("score"))
