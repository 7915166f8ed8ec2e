"""Quality control: detection of control samples, pairs, batches, control charts and run rules, duplicates, blanks, scores.

Rows are told apart by a ``row`` column, a number that follows the order of the samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelode.operators.ordering import equal_bins, held, quantiles, ranked
from corelode.operators.stats import _with as with_groups

# Patterns of sample ids by type, in any case; the first type that matches wins.
QC_PATTERNS = {
    "standard": (r"^STD[-_]?", r"^CRM[-_]?", r"^OREAS[-_]?", r"^GEOSTATS[-_]?", r"^SRM[-_]?", r"^REF[-_]?", r"STANDARD", r"^GBM[-_]?", r"^AMIS[-_]?"),
    "blank": (r"^BLK[-_]?", r"^BLANK", r"^FB[-_]?", r"^LB[-_]?", r"^MB[-_]?", r"BLANK$"),
    "field_duplicate": (r"[-_]DUP$", r"[-_]FD$", r"[-_]A$", r"^DUP[-_]?", r"DUPLICATE"),
    "pulp_duplicate": (r"[-_]PD$", r"[-_]RPT$", r"[-_]REP$", r"PULP[-_]?DUP"),
    "core_duplicate": (r"[-_]CD$", r"[-_]QC$", r"CORE[-_]?DUP"),
}
# Suffixes of duplicates by type, in any case; the first that matches is taken off.
SUFFIXES = {
    "field_duplicate": (r"[-_]DUP$", r"[-_]FD$", r"[-_]A$", r"[-_]B$", r"(?<=\d)[AB]$"),
    "pulp_duplicate": (r"[-_]PD$", r"[-_]RPT$", r"[-_]REP$"),
    "core_duplicate": (r"[-_]CD$", r"[-_]QC$"),
}
STANDARD_PREFIXES = (r"^STD[-_]?", r"^CRM[-_]?", r"^SRM[-_]?", r"^REF[-_]?")
#: Samples without a batch of their own are dealt to batches of so many.
BATCH_SIZE = 50


def _like(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def qc_type(sample_id: Column) -> Column:
    """The type of control sample that an id names; null for other samples and for null or empty ids."""
    out = F.when(sample_id.isNull() | (sample_id == ""), None)
    for name, patterns in QC_PATTERNS.items():
        out = out.when(_like(sample_id, "|".join(patterns)), name)
    return out


def standard_name(sample_id: Column) -> Column:
    """The reference material in a standard's id: prefix off, letters, digits and one letter kept, upper case."""
    name = F.trim(sample_id)
    out = None
    for prefix in STANDARD_PREFIXES:
        hit, rest = _like(name, prefix), F.regexp_replace(name, "(?i)" + prefix, "")
        out = F.when(hit, rest) if out is None else out.when(hit, rest)
    bare = out.otherwise(name)
    core = F.regexp_extract(bare, r"^([A-Za-z]+[-_]?\d+[A-Za-z]?)", 1)
    return F.when(core != "", F.upper(core)).when(bare != "", F.upper(bare))


def base_id(sample_id: Column, kind: str | None = None) -> Column:
    """The id without its duplicate suffix of one type (of any type where none is named)."""
    # No two of the suffixes fit one end, so one pass over all of them takes off the first that matches.
    suffixes = SUFFIXES[kind] if kind else [s for own in SUFFIXES.values() for s in own]
    return F.regexp_replace(F.trim(sample_id), f"(?i)(?:{'|'.join(suffixes)})", "")


def detect(samples: DataFrame, id_col: str) -> DataFrame:
    """``samples`` with qc_type and, for standards, standard_name."""
    kind = qc_type(F.col(id_col))
    return samples.withColumn("qc_type", kind).withColumn("standard_name", F.when(F.col("qc_type") == "standard", standard_name(F.col(id_col))))


def insertion_rate(samples: DataFrame, id_col: str) -> DataFrame:
    """(qc_type, n, pct): how many of all samples are control samples, by type and over all of them."""
    kinds = samples.groupBy(qc_type(F.col(id_col)).alias("qc_type")).count()
    total = kinds.agg(F.sum("count").alias("total"))
    told = kinds.where("qc_type is not null").select("qc_type", F.col("count").alias("n"))
    every = told.union(told.agg(F.lit("overall"), F.coalesce(F.sum("n"), F.lit(0))))
    return every.join(total).select("qc_type", "n", F.try_divide(100 * F.col("n"), F.col("total")).alias("pct"))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select("original_row", "duplicate_row", "original_id", "duplicate_id", "kind")


def _paired(samples: DataFrame, id_col: str, row: str, kinds: list[str], letters: bool, value: str | None = None) -> DataFrame:
    """(original_row, duplicate_row, original_id, duplicate_id, kind[, value, value_dup]) by suffixes of ``kinds`` and by letters.

    A sample tells its own name, a base for each suffix it has, and its base before a letter: mostly one cell.  One grouping of these cells finds
    the original of each base, and only samples with a suffix or letter meet it.
    """
    name = F.trim(F.col(id_col))
    rows = samples.where(F.coalesce(F.col(id_col), F.lit("")) != "")
    rows = rows.select(F.struct(F.col(row).alias("row"), name.alias("id"), *([F.col(value).cast("double").alias("v")] if value else [])).alias("r"), name.alias("id"), F.col(id_col).alias("raw"))
    none = F.lit(None).cast("string")
    cell = lambda space, key, kind: F.struct(F.lit(space).alias("space"), key.alias("key"), kind.alias("kind"))
    cells = [cell("name", F.col("id"), none)] if kinds else []
    # Bases are columns of their own, so that each is worked out once.
    rows = rows.withColumns({f"base_{kind}": base_id(F.col("raw"), kind) for kind in kinds})
    for kind in kinds:
        base = F.col(f"base_{kind}")
        cells.append(cell("name", F.when(F.col("id") != base, base), F.lit(kind)))
    if letters:
        # Most ids lack the letter and need no search for the longest part before it.
        rows = rows.withColumns({f"part_{x}": F.when(F.upper("id").contains(x), F.upper(F.regexp_extract("id", rf"(?i)(.+(?:[-_]|\d)){x}$", 1))) for x in "AB"})
        part = lambda letter: F.nullif(F.col(f"part_{letter}"), F.lit(""))
        cells += [cell("letter", part("A"), none), cell("letter", part("B"), F.lit("field_duplicate"))]
    # The plain array goes first: of a filtered one Spark would infer a filter that works all bases out again.
    told = rows.select("r", F.explode(F.array(*cells)).alias("c")).where("c.key is not null").select("r", "c.*")
    own = {k: F.min(F.when(F.col("kind") == k, F.col("r"))).alias(f"first_{k}") for k in kinds}
    first = told.groupBy("space", "key").agg(F.max(F.when(F.col("kind").isNull(), F.col("r"))).alias("bare"), *own.values())
    both = told.where("kind is not null").join(first, ["space", "key"])
    o = F.col("bare")
    for k in kinds:
        # Without the bare name the first with the suffix stands for it.
        o = F.coalesce(o, F.when((F.col("space") == "name") & (F.col("kind") == k), F.col(f"first_{k}")))
    both = both.withColumn("o", o).where("o.row <> r.row")
    columns = {"original_row": "o.row", "duplicate_row": "r.row", "original_id": "o.id", "duplicate_id": "r.id", "kind": "kind"} | ({"value": "o.v", "value_dup": "r.v"} if value else {})
    return both.select(*[F.col(c).alias(n) for n, c in columns.items()])


def suffix_pairs(samples: DataFrame, id_col: str, kind: str, row: str = "row") -> DataFrame:
    """Each sample with a suffix of ``kind`` beside its original: the last sample with the bare id, else the first of that base."""
    return _pairs(_paired(samples, id_col, row, [kind], False))


def letter_pairs(samples: DataFrame, id_col: str, row: str = "row") -> DataFrame:
    """Samples ending in B beside the last sample that ends in A on the same base; a separator or digit goes before the letter."""
    return _pairs(_paired(samples, id_col, row, [], True))


def all_pairs(samples: DataFrame, id_col: str, row: str = "row", value: str | None = None) -> DataFrame:
    """Distinct pairs of all three types; letter pairs count as field duplicates.  With a value column, both measurements too."""
    return _paired(samples, id_col, row, list(SUFFIXES), True, value).dropDuplicates(["original_row", "duplicate_row", "kind"])


def column_pairs(samples: DataFrame, id_col: str, pair_col: str, kind: str = "field_duplicate", row: str = "row") -> DataFrame:
    """Samples beside the last sample that their pair column names, in any case."""
    name = F.trim(F.col(id_col))
    first = samples.where(F.coalesce(F.col(id_col), F.lit("")) != "").groupBy(F.upper(name).alias("key")).agg(F.max(F.struct(F.col(row).alias("row"), name.alias("id"))).alias("o"))
    rows = samples.where(F.coalesce(F.col(pair_col), F.lit("")) != "").select(F.col(row).alias("row"), name.alias("id"), F.upper(F.trim(F.col(pair_col))).alias("key"))
    both = rows.join(first, "key").where("o.row <> row")
    return _pairs(both.select(F.col("o.row").alias("original_row"), F.col("row").alias("duplicate_row"), F.col("o.id").alias("original_id"), F.col("id").alias("duplicate_id"), F.lit(kind).alias("kind")))


def with_values(pairs: DataFrame, samples: DataFrame, value: str, row: str = "row") -> DataFrame:
    """Pairs with both measurements, as value and value_dup; pairs missing one are left out."""
    at = samples.where(F.col(value).isNotNull()).select(F.col(row).alias("at"), F.col(value).cast("double").alias("v"))
    left = pairs.join(at.withColumnRenamed("v", "value"), F.col("original_row") == F.col("at")).drop("at")
    return left.join(at.withColumnRenamed("v", "value_dup"), F.col("duplicate_row") == F.col("at")).drop("at")


def duplicate_pairs(samples: DataFrame, id_col: str, value: str, row: str | None = None) -> DataFrame:
    """(original, duplicate, value, value_dup, kind) of every duplicate; without a row column ids are told apart by id and value."""
    if row is None:
        samples, row = samples.withColumn("row", F.struct(id_col, value)), "row"
    told = all_pairs(samples, id_col, row, value).where("value is not null and value_dup is not null")
    return told.select(F.col("original_id").alias("original"), F.col("duplicate_id").alias("duplicate"), "value", "value_dup", "kind")


def batch_of(sample_id: Column) -> Column:
    """The batch that an id names (BATCH001 anywhere, _B001 at its end); null where it names none."""
    whole, tail = F.regexp_extract(sample_id, r"(?i)BATCH[-_]?(\d+)", 1), F.regexp_extract(sample_id, r"(?i)[-_]B(\d+)$", 1)
    return F.when(whole != "", F.concat(F.lit("BATCH"), whole)).when(tail != "", F.concat(F.lit("B"), tail))


def batches(samples: DataFrame, id_col: str, row: str = "row", batch_col: str | None = None, size: int = BATCH_SIZE) -> DataFrame:
    """``samples`` with their batch: the batch column's, the id's, else AUTO_BATCH_k of ``size`` samples in row order."""
    own = batch_of(F.col(id_col))
    if batch_col:
        own = F.when(F.coalesce(F.col(batch_col).cast("string"), F.lit("")) != "", F.col(batch_col).cast("string")).otherwise(own)
    told = samples.withColumn("batch", own)
    rest = ranked(told.where("batch is null"), row, [row], "__rank").withColumn("batch", F.concat(F.lit("AUTO_BATCH_"), (F.floor((F.col("__rank") - 1) / size) + 1).cast("string")))
    return told.where("batch is not null").unionByName(rest.drop("__rank"))


def control_limits(series: DataFrame, group: str, value: str, certified: DataFrame | None = None) -> DataFrame:
    """(group, mean, sd, centre, sigma) of each standard; ``certified`` has (group, certified, uncertainty).

    A certified value is the centre; half its uncertainty is sigma where the uncertainty exceeds the measured deviation.
    A sigma of 0, or of one value, becomes 5 % of the centre.
    """
    found = series.groupBy(group).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(value).alias("n"))
    if certified is not None:
        found = found.join(certified.select(F.col(group).alias("__g"), "certified", "uncertainty"), F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
    else:
        found = found.withColumn("certified", F.lit(None).cast("double")).withColumn("uncertainty", F.lit(None).cast("double"))
    sigma = F.when(F.col("certified").isNotNull() & (F.col("uncertainty") > F.col("sd")), F.col("uncertainty") / 2).otherwise(F.col("sd"))
    found = found.withColumn("centre", F.coalesce("certified", "mean")).withColumn("sigma", sigma)
    return found.withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.abs("centre") * 0.05))


def point_status(value: Column, centre: Column, sigma: Column) -> Column:
    """fail beyond 3 sigma, warning beyond 2, else pass."""
    off = F.abs(value - centre)
    return F.when(off > 3 * sigma, "fail").when(off > 2 * sigma, "warning").otherwise("pass")


def recovery(value: Column, certified: Column) -> Column:
    """Percent of the certified value; 0 where that is 0."""
    return F.when(certified == 0, 0.0).otherwise(100 * value / certified)


def _limited(series: DataFrame, group: str, limits: DataFrame) -> DataFrame:
    """Each point beside its group's limits; a null group is a group.  Left to Spark's own choice of join."""
    own = limits.withColumnRenamed(group, "__g")
    return series.join(own, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def control_chart(series: DataFrame, group: str, order: list[str], value: str, certified: DataFrame | None = None) -> DataFrame:
    """Each point with its group's centre and limits, its status and the run rules that it completes.

    Status: fail beyond 3 deviations, warning beyond 2.  Rules: two in a row beyond 2 on one side
    (2-2s), a step over 4 deviations (R-4s), four beyond 1 on one side (4-1s), ten on one side (10x),
    seven strictly rising or falling (7T).  A sigma of 0 breaks no rule.
    """
    limits = control_limits(series, group, value, certified).select(group, "centre", F.col("sigma").alias("sd"), "certified")
    w = Window.partitionBy(group).orderBy(*order)
    p = _limited(series, group, limits).withColumn("z", F.try_divide(F.col(value) - F.col("centre"), F.col("sd")))

    def run(n: int, lower: float) -> Column:
        back = w.rowsBetween(1 - n, 0)
        return (F.count("z").over(back) == n) & ((F.min("z").over(back) > lower) | (F.max("z").over(back) < -lower))

    p = p.withColumn("step", F.sign(F.col(value) - F.lag(value).over(w)))
    six = w.rowsBetween(-5, 0)
    rising = (F.count("step").over(six) == 6) & (F.min("step").over(six) == F.max("step").over(six)) & (F.col("step") != 0)
    return p.select(
        *series.columns, "centre", "sd", point_status(F.col(value), F.col("centre"), F.col("sd")).alias("status"),
        F.when(F.col("certified").isNotNull(), recovery(F.col(value), F.col("certified"))).alias("recovery"), run(2, 2).alias("rule_2_2s"),
        F.coalesce(F.abs(F.col("z") - F.lag("z").over(w)) > 4, F.lit(False)).alias("rule_r_4s"),
        run(4, 1).alias("rule_4_1s"), run(10, 0).alias("rule_10x"), rising.alias("rule_7t"),
    )


def chart_summary(series: DataFrame, group: str, order: list[str], value: str, certified: DataFrame | None = None) -> DataFrame:
    """(group, n, passed, warned, failed, pass_pct, bias, drift) of each standard; a warning counts as passed.

    Bias: two warnings in a row on one side of the centre.  Drift: a slope over 2 % of the mean a point, of at least five points.
    """
    chart = control_chart(series.where(F.col(value).isNotNull()), group, order, value, certified)
    w = Window.partitionBy(group).orderBy(*order)
    side = F.when(F.col("status") == "warning", F.when(F.col(value) > F.col("centre"), 1).otherwise(-1))
    turned = chart.withColumn("__side", side).withColumn("__n", F.row_number().over(w) - 1)
    turned = turned.withColumn("__same", F.coalesce(F.col("__side") == F.lag("__side").over(w), F.lit(False)))
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    found = turned.groupBy(group).agg(
        F.count("*").alias("n"), count("pass").alias("passed"), count("warning").alias("warned"), count("fail").alias("failed"),
        F.max("__same").alias("bias"), F.regr_slope(value, "__n").alias("slope"), F.avg(value).alias("mean"),
    )
    drift = F.coalesce((F.col("n") >= 5) & (F.abs(F.try_divide(F.col("slope"), F.col("mean"))) * 100 > 2), F.lit(False))
    pct = 100 * (F.col("passed") + F.col("warned")) / F.col("n")
    return found.select(group, "n", "passed", "warned", "failed", pct.alias("pass_pct"), "bias", drift.alias("drift"))


def duplicate_differences(pairs: DataFrame, limit_of_detection: float | None = None) -> DataFrame:
    """Pairs with their mean, rpd, ard and hard in percent, and ``low``: both values under 5 detection limits."""
    a, b = F.col("value"), F.col("value_dup")
    low = (a < 5 * limit_of_detection) & (b < 5 * limit_of_detection) if limit_of_detection else F.lit(False)
    share = F.coalesce(F.try_divide(F.abs(a - b), (a + b) / 2), F.lit(0.0))
    return pairs.select("*", ((a + b) / 2).alias("mean"), (share * 100).alias("rpd"), (F.abs(share) * 100).alias("ard"), (share * 50).alias("hard"), low.alias("low"))


def duplicate_precision(pairs: DataFrame, limit_of_detection: float, threshold: float = 30.0, by: list[str] = ("kind",)) -> DataFrame:
    """Pair counts, relative differences and precision; pairs with both values under 5 detection limits are set aside."""
    a, b = F.col("value"), F.col("value_dup")
    low = (a < 5 * limit_of_detection) & (b < 5 * limit_of_detection)
    rpd = F.try_divide(F.abs(a - b) * 200, a + b)
    p = pairs.select(*by, low.alias("low"), F.when(~low, rpd).alias("rpd"), F.when(~low, (a - b) ** 2).alias("d2"), F.when(~low, (a + b) / 2).alias("m")).persist()
    try:
        told = p.groupBy(*by).agg(
            F.count("*").alias("pairs"), F.count(F.when(F.col("low"), 1)).alias("low_pairs"), F.count(F.when(F.col("rpd") > threshold, 1)).alias("failed"),
            F.avg("rpd").alias("mean_rpd"), F.sqrt(F.try_divide(F.sum("d2"), 2 * F.count("d2"))).alias("precision"), F.avg("m").alias("mean_value"),
        )
        middle = quantiles(p, {"__median": "rpd"}, [0.5], by)
        both = with_groups(held(told), middle, by)
        return both.select(*by, "pairs", "low_pairs", "failed", "mean_rpd", F.col("__median")[0].alias("median_rpd"), "precision", "mean_value")
    finally:
        p.unpersist()


def thompson_howarth_bins(pairs: DataFrame, order: list[str], bins: int = 6) -> DataFrame:
    """(bin, low, high, mean, precision, pairs) over pairs by rising mean, in about ``bins`` equal bins of 3 at least.

    Of equal means the smaller difference comes first; ``order`` tells pairs apart that are equal in both, which no bin shows.

    Precision is the root of the squared differences over twice their number.  Pairs whose mean is not positive are
    left out; with fewer than six pairs, or three bins of two, there is no row.
    """
    m = (F.col("value") + F.col("value_dup")) / 2
    p = pairs.select(m.alias("m"), ((F.col("value") - F.col("value_dup")) ** 2).alias("d2")).where("m > 0").persist()
    try:
        b = equal_bins(p, "m", "d2", lambda n: max(3, n // bins)).where("pairs >= 2")
        found = held(b.select("bin", "low", "high", (F.col("sum_m") / F.col("pairs")).alias("mean"), F.sqrt(F.col("sum_d2") / (2 * F.col("pairs"))).alias("precision"), "pairs"))
        several = p.limit(6).count() == 6 and found.count() >= 3
        return found if several else found.limit(0)
    finally:
        p.unpersist()


def thompson_howarth(pairs: DataFrame, order: list[str], bins: int = 6) -> DataFrame:
    """Slope, intercept and R2 of log10 precision on log10 mean over the bins; 0 where fewer than three bins are positive."""
    b = thompson_howarth_bins(pairs, order, bins).where("mean > 0 and precision > 0")
    x, y = F.log10("mean"), F.log10("precision")
    fit = b.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("bins"))
    enough = F.col("bins") >= 3
    return fit.select(*[F.coalesce(F.when(enough, F.col(c)), F.lit(0.0)).alias(c) for c in ("slope", "intercept", "r2")], "bins")


def thompson_howarth_curve(fit: DataFrame, low: float, high: float, points: int = 50) -> DataFrame:
    """(concentration, precision): the fitted line at ``points`` concentrations, evenly spaced in their logarithm."""
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    at = F.pow(F.lit(10.0), F.lit(low).cast("double") * 0 + F.log10(F.lit(low)) + F.col("k") / (points - 1) * (F.log10(F.lit(high)) - F.log10(F.lit(low))))
    rows = fit.select("slope", "intercept", step).withColumn("concentration", at)
    return rows.select("concentration", F.pow(F.lit(10.0), F.col("slope") * F.log10("concentration") + F.col("intercept")).alias("precision"))


def blank_status(series: DataFrame, value: str, limit_of_detection: float | None = None) -> DataFrame:
    """Blanks with their adjusted value ``v`` and status.

    With a detection limit, negatives count as half of it, over 10 limits is contaminated and over 5 elevated; without one,
    over the mean by 3 sample deviations or 2.
    """
    if limit_of_detection:
        v = F.when(F.col(value) < 0, limit_of_detection / 2).otherwise(F.col(value))
        status = F.when(v > 10 * limit_of_detection, "contaminated").when(v > 5 * limit_of_detection, "elevated").otherwise("clean")
        return series.where(F.col(value).isNotNull()).select("*", v.cast("double").alias("v"), status.alias("status"))
    told = series.where(F.col(value).isNotNull()).withColumn("v", F.col(value).cast("double"))
    both = told.join(told.agg(F.avg("v").alias("__m"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("__s")))
    status = F.when(F.col("v") > F.col("__m") + 3 * F.col("__s"), "contaminated").when(F.col("v") > F.col("__m") + 2 * F.col("__s"), "elevated").otherwise("clean")
    return both.withColumn("status", status).drop("__m", "__s")


def blanks(series: DataFrame, order: list[str], value: str, limit_of_detection: float | None) -> DataFrame:
    """Counts, mean and largest value of blanks by status."""
    found = blank_status(series, value, limit_of_detection)
    return found.groupBy("status").agg(F.count("*").alias("n"), F.avg("v").alias("mean_value"), F.max("v").alias("max_value"))


def contamination_events(samples: DataFrame, id_col: str, value: str, limit_of_detection: float | None, row: str = "row") -> DataFrame:
    """Blanks with the sample one row before them; an event is a contaminated blank after a sample of over ten times its value."""
    found = blank_status(samples.where(qc_type(F.col(id_col)) == "blank"), value, limit_of_detection)
    before = samples.select((F.col(row) + 1).alias("__at"), F.col(id_col).alias("preceding_id"), F.col(value).cast("double").alias("preceding_value"))
    both = found.join(before, F.col(row) == F.col("__at"), "left").drop("__at")
    event = F.coalesce((F.col("status") == "contaminated") & (F.col("preceding_value") > 10 * F.col(value)), F.lit(False))
    return both.select(F.col(row).alias("row"), F.col(id_col).alias("id"), "v", "status", "preceding_id", "preceding_value", event.alias("event"))


# Weights of the pass rates, deduction for a missing type, lower bounds of the grades.
WEIGHTS, MISSING, GRADES = {"standard": 0.4, "duplicate": 0.35, "blank": 0.25}, 5, ((95, "A"), (85, "B"), (75, "C"), (60, "D"))


def qc_score(standard: Column, blank: Column, duplicate: Column) -> Column:
    """0 to 100 from pass rates in percent; a null rate is a type without samples: its weight is shared out and 5 points go."""
    rates = {"standard": standard, "blank": blank, "duplicate": duplicate}
    weight = sum((F.when(r.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, r in rates.items()), F.lit(0.0))
    total = sum((F.coalesce(r * WEIGHTS[k], F.lit(0.0)) for k, r in rates.items()), F.lit(0.0))
    gone = sum((F.when(r.isNull(), MISSING).otherwise(0) for r in rates.values()), F.lit(0))
    return F.coalesce(F.greatest(F.lit(0.0), F.try_divide(total, weight) - gone), F.lit(0.0))


def grade(score: Column) -> Column:
    out = None
    for bound, letter in GRADES:
        out = F.when(score >= bound, letter) if out is None else out.when(score >= bound, letter)
    return out.otherwise("F")


def element_summary(samples: DataFrame, id_col: str, elements: list[str], row: str = "row", limits: dict[str, float] | None = None, threshold: float = 30.0) -> DataFrame:
    """(element, standard_pct, blank_pct, duplicate_pct, score, grade): pass rates of each element over all its control samples."""
    told, pairs, out = detect(samples, id_col), all_pairs(samples, id_col, row), None
    for e in elements:
        limit = (limits or {}).get(e)
        charts = chart_summary(told.where("qc_type = 'standard'").select("standard_name", row, e), "standard_name", [row], e)
        s = charts.agg(F.try_divide(100 * F.sum(F.col("passed") + F.col("warned")), F.sum("n")).alias("standard_pct"))
        b = blank_status(told.where("qc_type = 'blank'"), e, limit).agg((100 * F.avg((F.col("status") == "clean").cast("double"))).alias("blank_pct"))
        d = duplicate_differences(with_values(pairs, samples, e, row), limit).where("not low").agg((100 * F.avg((F.col("rpd") <= threshold).cast("double"))).alias("duplicate_pct"))
        one = s.join(b).join(d).select(F.lit(e).alias("element"), "standard_pct", "blank_pct", "duplicate_pct")
        out = one if out is None else out.union(one)
    scored = out.withColumn("score", qc_score(F.col("standard_pct"), F.col("blank_pct"), F.col("duplicate_pct")))
    return scored.withColumn("grade", grade(F.col("score")))


def batch_report(samples: DataFrame, id_col: str, row: str = "row", batch_col: str | None = None) -> DataFrame:
    """(batch, n, standards, blanks, duplicates, insertion_pct) of each batch."""
    told = detect(batches(samples, id_col, row, batch_col), id_col)
    count = lambda c: F.count(F.when(c, 1))
    kind = F.col("qc_type")
    found = told.groupBy("batch").agg(
        F.count("*").alias("n"), count(kind == "standard").alias("standards"), count(kind == "blank").alias("blanks"), count(kind.endswith("duplicate")).alias("duplicates")
    )
    return found.withColumn("insertion_pct", 100 * (F.col("standards") + F.col("blanks") + F.col("duplicates")) / F.col("n"))


def overall_grade(summary: DataFrame) -> DataFrame:
    """(score, grade): the mean score of an ``element_summary`` and its grade; 0 and F without elements."""
    mean = F.coalesce(F.avg("score"), F.lit(0.0))
    return summary.agg(mean.alias("score")).withColumn("grade", grade(F.col("score")))


# Pass rates in percent below which a type calls for action.
ACTION = {"standard_pct": (85, "poor accuracy of standards"), "blank_pct": (90, "contaminated blanks"), "duplicate_pct": (80, "poor precision of duplicates")}


def recommendations(summary: DataFrame) -> DataFrame:
    """(finding, elements) of an ``element_summary``: types whose pass rate calls for action, and failing or else marginal grades; ``satisfactory`` if none."""
    named = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("element"))))
    cells = {text: F.col(c) < bound for c, (bound, text) in ACTION.items()} | {"failing grade": F.col("grade") == "F", "marginal grade": F.col("grade") == "D"}
    row = summary.agg(*[named(c).alias(f"c{k}") for k, c in enumerate(cells.values())])
    failing = F.size(f"c{len(cells) - 2}") > 0
    found = [F.when((F.size(f"c{k}") > 0) & (F.lit(text != "marginal grade") | ~failing), F.struct(F.lit(text).alias("finding"), F.col(f"c{k}").alias("elements"))) for k, text in enumerate(cells)]
    listed = F.filter(F.array(*found), lambda x: x.isNotNull())
    none = F.array(F.struct(F.lit("satisfactory").alias("finding"), F.array().cast("array<string>").alias("elements")))
    return row.select(F.inline(F.when(F.size(listed) > 0, listed).otherwise(none)))
