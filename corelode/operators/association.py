"""Element associations of principal components matched with reference patterns, as joins of loadings with pattern elements."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A reference signature: elements by tier, those that speak against it, and the share of core elements it takes at least."""

    id: str
    name: str
    category: str
    core: tuple[str, ...]
    common: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    anti: tuple[str, ...] = ()
    least_core: float = 0.4


@dataclass(frozen=True)
class Scoring:
    """Weights of the tiers and of the loadings' strength, deduction for each element against, thresholds."""

    # Fixed values.
    core: float = 0.5
    common: float = 0.25
    optional: float = 0.1
    strength: float = 0.15
    anti: float = 0.15
    strong: float = 0.5
    moderate: float = 0.3
    #: Loadings from here to the threshold count half, for core elements.
    near: float = 0.2
    partial: float = 0.5
    #: Range of matched loadings without deduction; twice that range costs the largest deduction.
    coherent: float = 0.3
    incoherence: float = 0.6
    levels: tuple[tuple[float, str], ...] = field(default=((70, "high"), (50, "moderate"), (25, "low")))
    lithophile: tuple[str, ...] = ("Al", "Zr", "Ti", "Y", "Hf", "Nb", "Th", "Ga", "Sc")
    #: Points a discriminating element gives per unit of loading: core of one pattern alone, core of one and common of the other.
    sole: float = 5.0
    shared: float = 2.0


# A selection of patterns; the full list is a parameter.
PATTERNS = (
    Pattern("LITH_MAFIC", "Mafic Rock", "lithological", ("Mg", "Sc", "Ni", "Cr", "V"), ("Ca", "Co", "Mn", "Cu", "Fe", "Ti", "Li"), ("Zn", "P"), ("Pb", "U", "Zr", "Th", "Rb", "K", "Cs"), 0.4),
    Pattern("LITH_FELSIC", "Felsic Rock", "lithological", ("Pb", "U", "Zr", "Th", "Rb", "K"), ("Nb", "La", "Mo", "Tl", "Sn", "W", "Bi", "Y", "Hf"), ("Cs", "Ta", "Ce"), ("Mg", "Ni", "Cr", "Sc", "V"), 0.5),
    Pattern("LITH_ULTRAMAFIC", "Ultramafic Rock", "lithological", ("Cr", "Ni", "Mg"), ("Pt", "Pd", "Au", "Co", "Fe"), ("Cu", "Ir", "Os", "Ru"), ("Zr", "Th", "Rb", "K", "Pb", "U"), 0.67),
    Pattern("MIN_VHMS", "VHMS (VMS) Mineralisation", "mineralisation", ("Sn", "Bi", "In", "Au", "Ag"), ("As", "Sb", "Hg", "Te", "Se", "Cu", "Zn", "Cd", "Pb"), ("Mo", "W", "Tl"), (), 0.4),
    Pattern("MIN_PORPHYRY_CU", "Porphyry Cu(-Au-Mo)", "mineralisation", ("Cu", "Au", "Ag", "Mo", "Bi", "Te"), ("Re", "Se", "Pd", "Pt"), ("W", "Sn", "In"), (), 0.4),
    Pattern("MIN_SHMS", "SHMS (SEDEX) Mineralisation", "mineralisation", ("Pb", "Zn", "Cd", "Ag"), ("As", "Sb", "Tl", "Hg", "Ba"), ("Mn", "Fe", "Bi"), (), 0.5),
    Pattern("MIN_MVT", "MVT Mineralisation", "mineralisation", ("Pb", "Zn", "Cd", "Ag"), ("As", "Sb", "Cu", "Ni", "Co"), ("Ge", "Ga", "Fe"), ("Tl", "Hg"), 0.5),
)
# Pairs of patterns and the elements that tell them apart.
RULES = (
    ("MIN_SHMS", "MIN_MVT", ("Tl", "Hg", "Ge", "Ga")),
    ("MIN_VHMS", "MIN_SHMS", ("Sn", "Bi", "In")),
    ("LITH_MAFIC", "LITH_ULTRAMAFIC", ("Ti", "Sc", "Cr")),
)

_TIERS = ("core", "common", "optional", "anti")


def pattern_elements(spark, patterns=PATTERNS) -> DataFrame:
    """(pattern, tier, element)."""
    rows = [(p.id, tier, e) for p in patterns for tier in _TIERS for e in getattr(p, tier)]
    return spark.createDataFrame(rows, "pattern string, tier string, element string")


def _bonuses(spark, patterns, rules, scoring: Scoring) -> DataFrame:
    """(rule, pattern, rival, element, points): what a discriminating element gives to which pattern, against which other."""
    known, rows = {p.id: p for p in patterns}, []
    for k, (a, b, elements) in enumerate(rules):
        if a not in known or b not in known:
            continue
        one, two = known[a], known[b]
        for e in elements:
            in_one, in_two = e in one.core, e in two.core
            if in_one != in_two:
                rows.append((k, a, b, e, scoring.sole) if in_one else (k, b, a, e, scoring.sole))
            elif in_one and (e in two.common or e in one.common):
                rows.append((k, a, b, e, scoring.shared) if e in two.common else (k, b, a, e, scoring.shared))
    return spark.createDataFrame(rows, "rule int, pattern string, rival string, element string, points double")


def ends(loadings: DataFrame, threshold: float, by: list[str], scoring: Scoring) -> DataFrame:
    """(by, end, element, strength, held, near): each element at either end of a component, with how far it lies towards that end."""
    both = F.explode(F.array(F.struct(F.lit("positive").alias("end"), F.col("loading").alias("strength")), F.struct(F.lit("negative").alias("end"), (-F.col("loading")).alias("strength"))))
    near = (F.col("strength") > 0) & (F.col("strength") >= max(scoring.near, threshold - 0.1)) & (F.col("strength") < threshold)
    return loadings.select(*by, "element", both.alias("b")).select(*by, "element", "b.*").withColumns({"held": F.col("strength") >= threshold, "near": near})


def associate(loadings: DataFrame, patterns=PATTERNS, rules=RULES, threshold: float = 0.3, least: float = 25.0, most: int | None = 5, by: list[str] = ("component",), scoring: Scoring = Scoring()) -> DataFrame:
    """Reference patterns that fit either end of each component, best first.

    ``loadings`` has ``by``, element and loading.  A pattern is scored by the shares of its measured elements that load beyond
    ``threshold``, core elements just below it by half; elements against it, and matched loadings that lie far apart, take away.
    Two patterns of ``least`` points or more that a rule names are told apart by its elements.  Patterns of under ``least`` points are left out, and
    all but the ``most`` best (all for None).  Null loadings do not count; equal scores rank in the order of the patterns.
    """
    by, spark = list(by), loadings.sparkSession
    known = ends(loadings.where("loading is not null"), threshold, by, scoring)
    key = [*by, "end"]
    litho = F.col("element").isin(*scoring.lithophile)
    sets = known.groupBy(*key).agg(
        F.count(F.when(F.col("held"), 1)).alias("size"), F.coalesce(F.avg(F.when(F.col("held"), F.col("strength"))), F.lit(0.0)).alias("mean"), F.coalesce(F.max(F.col("held") & litho), F.lit(False)).alias("litho"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("held"), F.struct((-F.col("strength")).alias("s"), "element")))), lambda x: x["element"]), "-").alias("elements"),
    )
    listed = F.array(*[F.struct(F.lit(k).alias("turn"), *[F.lit(v).alias(n) for n, v in (("pattern", p.id), ("name", p.name), ("category", p.category), ("least_core", p.least_core), ("optional_size", len(p.optional)))]) for k, p in enumerate(patterns)])
    told = known.join(pattern_elements(spark, patterns), "element")
    n = lambda tier, extra=F.lit(True): F.count(F.when((F.col("tier") == tier) & extra, 1))
    matched = F.when(F.col("held") & F.col("tier").isin("core", "common"), F.col("strength"))
    counts = told.groupBy(*key, "pattern").agg(
        n("core").alias("core"), n("core", F.col("held")).alias("core_in"), n("core", F.col("near")).alias("core_near"), n("common").alias("common"), n("common", F.col("held")).alias("common_in"),
        n("optional", F.col("held")).alias("optional_in"), n("anti", F.col("held")).alias("anti_in"), F.coalesce(F.max(matched) - F.min(matched), F.lit(0.0)).alias("range"),
    )
    every = sets.withColumn("p", F.explode(listed)).select(*key, "size", "mean", "litho", "elements", "p.*").join(counts, [*key, "pattern"], "left").na.fill(0)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    effective = share("core_in", "core") + F.coalesce(F.try_divide(F.col("core_near") * scoring.partial, F.col("core")), F.lit(0.0))
    s = every.withColumns({
        "core_score": F.least(F.lit(100.0), effective * 100), "common_score": share("common_in", "common") * 100, "optional_score": share("optional_in", "optional_size") * 100,
        "strength_score": F.when(F.col("mean") >= scoring.strong, 100.0).when(F.col("mean") >= scoring.moderate, 50.0).otherwise(0.0), "short": (F.col("core") > 0) & (effective < F.col("least_core")),
    })
    raw = F.col("core_score") * scoring.core + F.col("common_score") * scoring.common + F.col("optional_score") * scoring.optional + F.col("strength_score") * scoring.strength - F.col("anti_in") * scoring.anti * 100
    lost = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("range") - scoring.coherent) / scoring.coherent)) * scoring.incoherence
    s = s.withColumn("confidence", F.when(F.col("short"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * (1 - lost)))))
    inside = F.col("core_in") + F.col("common_in") + F.col("optional_in")
    s = s.withColumns({
        "completeness": F.when(F.col("short"), 0.0).otherwise(F.coalesce(F.try_divide(100.0 * inside, F.col("core") + F.col("common") + F.col("optional_size")), F.lit(0.0))),
        "purity": F.when(F.col("short"), 0.0).otherwise(F.coalesce(F.try_divide(100.0 * inside, F.col("size")), F.lit(0.0))),
        "lithophile_interference": ~F.col("short") & (F.col("category") == "mineralisation") & F.col("litho"),
    })
    # Discrimination: both patterns of a rule must be of weight before it.
    weighty = s.where(F.col("confidence") >= 25).select(*key, F.col("pattern").alias("w"))
    given = known.where("held").join(_bonuses(spark, patterns, rules, scoring), "element").select(*key, "pattern", "rival", (F.col("strength") * F.col("points")).alias("points"))
    given = given.join(weighty.withColumnRenamed("w", "pattern"), [*key, "pattern"]).join(weighty.withColumnRenamed("w", "rival"), [*key, "rival"])
    s = s.join(given.groupBy(*key, "pattern").agg(F.sum("points").alias("bonus")), [*key, "pattern"], "left")
    s = s.withColumn("confidence", F.least(F.lit(100.0), F.col("confidence") + F.coalesce("bonus", F.lit(0.0))))
    level = None
    for bound, name in scoring.levels:
        level = F.when(F.col("confidence") >= bound, name) if level is None else level.when(F.col("confidence") >= bound, name)
    found = s.where(F.col("confidence") >= least).withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("confidence"), "turn")))
    found = found if most is None else found.where(F.col("rank") <= most)
    return found.select(*key, "rank", "pattern", "name", "category", "confidence", level.otherwise("none").alias("level"), "core_score", "common_score", "optional_score", "completeness", "purity", "lithophile_interference", "elements")


def association_quality(loadings: DataFrame, matches: DataFrame, threshold: float = 0.3, by: list[str] = ("component",), scoring: Scoring = Scoring()) -> DataFrame:
    """(by, positive, negative, independent, strong, separated, regolith, mineralised) of each component.

    ``independent``: no best match is a mineralisation with lithophile elements; ``separated``: one end's best match is a mineralisation, the other's a
    rock; ``strong``: mean loading of 0.5 or more at one end; ``regolith``: a best match is one, and one of over 40 points is among the matches.
    """
    by = list(by)
    sets = ends(loadings.where("loading is not null"), threshold, by, scoring).where("held").groupBy(*by, "end").agg(F.avg("strength").alias("mean")).groupBy(*by).agg(F.max("mean").alias("mean"))
    at = lambda end, c: F.max(F.when((F.col("end") == end) & (F.col("rank") == 1), F.col(c)))
    top = matches.groupBy(*by).agg(
        at("positive", "name").alias("positive"), at("negative", "name").alias("negative"), at("positive", "category").alias("p"), at("negative", "category").alias("n"),
        F.max((F.col("rank") == 1) & F.col("lithophile_interference")).alias("mixed"), F.max((F.col("category") == "regolith") & (F.col("confidence") > 40)).alias("soil"),
    )
    is_ = lambda c, what: F.coalesce(F.col(c) == what, F.lit(False))
    ore = lambda c: is_(c, "mineralisation")
    rock = lambda c: is_(c, "lithological")
    soil = (is_("p", "regolith") | is_("n", "regolith")) & F.coalesce("soil", F.lit(False))
    out = loadings.select(*by).distinct().join(sets, by, "left").join(top, by, "left")
    return out.select(
        *by, "positive", "negative", (~F.coalesce("mixed", F.lit(False))).alias("independent"), F.coalesce(F.col("mean") >= scoring.strong, F.lit(False)).alias("strong"),
        ((ore("p") & rock("n")) | (ore("n") & rock("p"))).alias("separated"), soil.alias("regolith"), (ore("p") | ore("n")).alias("mineralised"),
    )
