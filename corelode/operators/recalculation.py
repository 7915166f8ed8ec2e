"""Whole-rock recalculation for magmatic sulfide deposits, in columns: volatile-free oxides, split of the iron, sulfide correction, sulfide-free oxides."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.functions.chemistry import ATOMIC_WEIGHT, FE2O3_TO_FEO
from corelode.operators.compose import clr

# Oxides apart from iron; ramps (MgO low, high, ratio of the liquid) by rock suite.
OXIDES = ("SiO2", "TiO2", "Al2O3", "MgO", "CaO", "Na2O", "K2O", "MnO", "P2O5", "Cr2O3")
SUITES = {"komatiite": (25.0, 50.0, 0.1), "komatiitic-basalt": (16.0, 48.0, 0.1), "mafic-cumulate": (10.0, 40.0, 0.1), "custom": (10.0, 50.0, 0.1)}
# Least raw total, largest MgO and total iron of a silicate, largest sulfide share, all in percent.
LEAST_TOTAL, MOST_MGO, MOST_IRON, MOST_SULFIDE, MOST_TENOR = 85.0, 52.0, 30.0, 50.0, 20.0
_S, _FE, _NI, _CU = (ATOMIC_WEIGHT[e] for e in ("S", "Fe", "Ni", "Cu"))
_FEO, _FE2O3 = _FE + ATOMIC_WEIGHT["O"], 2 * _FE + 3 * ATOMIC_WEIGHT["O"]


@dataclass(frozen=True)
class Assignment:
    """Columns by what they hold; iron by form: ``FeOT``, ``FeO``, ``Fe2O3T``, ``Fe2O3``, or both FeO and Fe2O3."""

    oxides: dict[str, str]
    iron: dict[str, str]
    sulfur: str | None = None
    copper: str | None = None
    nickel: str | None = None
    volatiles: tuple[str, ...] = ()
    #: Factors to weight percent of the oxide, for columns that hold something else.
    factors: dict[str, float] = field(default_factory=dict)
    #: Of S, Cu and Ni: those in parts per million.
    ppm: tuple[str, ...] = ()


def _known(column: str | None) -> Column:
    if column is None:
        return F.lit(None).cast("double")
    v = F.col(column).try_cast("double")
    return F.when(~F.isnan(v), v)


def _or_zero(column: str | None) -> Column:
    return F.coalesce(_known(column), F.lit(0.0))


def iron_ratio(mgo: Column, low: float, high: float, liquid: float) -> Column:
    """Molar Fe2O3 / (FeO + Fe2O3): that of the liquid up to ``low`` percent MgO, falling to none at ``high``."""
    return F.when(mgo >= high, 0.0).when(mgo <= low, liquid).otherwise(liquid * (1 - (mgo - low) / (high - low)))


def split_iron(total: Column, ratio: Column) -> tuple[Column, Column]:
    """(FeO, Fe2O3) in percent of total iron as FeO at a molar ratio."""
    moles = total / _FEO
    ferric = moles * ratio / (1 + ratio)
    return F.greatest(F.lit(0.0), (moles - 2 * ferric) * _FEO), ferric * _FE2O3


def recalculate(
    df: DataFrame, columns: Assignment, suite: str | tuple[float, float, float] = "komatiite", method: str = "auto", sulfur_limit: float = 2.0, sm: float = 1.0, fn: float = 3.0,
    silicate_nickel_ppm: float | None = None, most_volatile: float | None = None,
) -> DataFrame:
    """``df`` with ``<oxide>_anhyd``, ``FeOT_anhyd``, ``<oxide>_recalc``, ``FeO_recalc``, ``Fe2O3_recalc``, the sulfide's figures and ``recalc_status``.

    Rows go no further than their status: ``volatile`` (first volatile column beyond ``most_volatile``), ``incomplete`` (no SiO2 or iron), ``low total``,
    ``implausible`` (MgO or iron beyond what a silicate holds), ``sulfide`` (half the rock or more is), else ``ok``.  What a row does not reach is 0 for oxides and null for
    the sulfide's figures.  Method 1 takes silicate nickel from MgO, method 2 a ratio ``fn`` of iron to nickel; ``auto`` takes 1 beyond ``sulfur_limit`` percent of sulfur.
    Without a sulfur column there is no correction.  ``negative_iron`` marks sulfide iron below 0 (taken as 0), ``high_tenor`` a tenor beyond 20 percent (taken as null).
    """
    if method not in ("auto", "method1", "method2"):
        raise ValueError(f"unknown method {method}")
    low, high, liquid = SUITES[suite] if isinstance(suite, str) else suite
    temp: list[str] = []

    def named(frame: DataFrame, **made: Column) -> DataFrame:
        temp.extend(f"__{k}" for k in made if f"__{k}" not in temp)
        return frame.withColumns({f"__{k}": v for k, v in made.items()})

    v = lambda name: F.col(f"__{name}")
    own = {o: _or_zero(columns.oxides.get(o)) * columns.factors.get(o, 1.0) for o in OXIDES}
    if "FeO" in columns.iron and "Fe2O3" in columns.iron:
        iron, has_iron = _or_zero(columns.iron["FeO"]) + _or_zero(columns.iron["Fe2O3"]) * FE2O3_TO_FEO, _known(columns.iron["FeO"]).isNotNull() & _known(columns.iron["Fe2O3"]).isNotNull()
    else:
        form, name = next(iter(columns.iron.items()), ("FeOT", None))
        iron, has_iron = _or_zero(name) * (FE2O3_TO_FEO if form.startswith("Fe2O3") else 1.0), _known(name).isNotNull()
    metal = lambda e, c: _or_zero(c) * (1e-4 if e in columns.ppm else 1.0)
    volatile = reduce(add, [_or_zero(c) for c in columns.volatiles], F.lit(0.0))
    rows = named(df, **{f"raw_{o}": x for o, x in own.items()}, iron=iron, s=metal("S", columns.sulfur), cu=metal("Cu", columns.copper), ni=metal("Ni", columns.nickel), volatile=volatile)
    solid = reduce(add, [v(f"raw_{o}") for o in OXIDES]) + v("iron") + v("s") + v("cu") + v("ni")
    gone = _known(columns.volatiles[0]) > most_volatile if most_volatile is not None and columns.volatiles else F.lit(False)
    gate = F.when(F.coalesce(gone, F.lit(False)), "volatile").when(_known(columns.oxides.get("SiO2")).isNull() | ~has_iron, "incomplete").when(solid + v("volatile") < LEAST_TOTAL, "low total")
    rows = named(rows, factor=F.when(solid > 0, 100 / F.when(solid > 0, solid)).otherwise(1.0), gate=gate)
    rows = named(rows, **{f"a_{o}": v(f"raw_{o}") * v("factor") for o in OXIDES}, **{f"a_{k}": v(k) * v("factor") for k in ("iron", "s", "cu", "ni")})
    oxides = reduce(add, [v(f"a_{o}") for o in OXIDES])
    ratio = iron_ratio(v("a_MgO"), low, high, liquid)
    if columns.sulfur is None:
        rows = named(rows, left=v("a_iron"), fe=F.lit(None).cast("double"), nisil=F.lit(None).cast("double"), nisul=F.lit(None).cast("double"), mode=F.lit(None).cast("double"), tenor=F.lit(None).cast("double"), method=F.lit(None).cast("int"), negative=F.lit(False))
    else:
        first = v("a_s") > sulfur_limit if method == "auto" else F.lit(method == "method1")
        silicate = oxides + v("a_iron")
        from_mgo = F.greatest(F.lit(0.0), F.when(silicate > 0, v("a_MgO") * 100 / F.when(silicate > 0, silicate)).otherwise(0.0) - 10) * 90 * (silicate / 100) * 1e-4
        given = from_mgo if silicate_nickel_ppm is None else F.lit(silicate_nickel_ppm * 1e-4)
        of = lambda nickel: (v("a_s") / _S - v("a_cu") / _CU / sm - F.greatest(F.lit(0.0), v("a_ni") - nickel) / _NI) * _FE
        by_ratio = fn / (1 + fn) * v("a_s") / _S * _FE / sm
        nisul = F.when(first, F.greatest(F.lit(0.0), v("a_ni") - given)).otherwise(v("a_s") / _S * _NI / (fn + 1) / sm)
        rows = named(rows, method=F.when(first, 1).otherwise(2), nisul=nisul, fe=F.greatest(F.lit(0.0), F.when(first, of(given)).otherwise(by_ratio)), negative=F.when(first, of(from_mgo)).otherwise(by_ratio) < 0, given=given)
        rows = named(rows, nisil=F.when(v("method") == 1, v("given")).otherwise(F.greatest(F.lit(0.0), v("a_ni") - v("nisul"))), mode=v("a_s") + v("fe") + v("nisul") + v("a_cu"), left=F.greatest(F.lit(0.0), v("a_iron") - v("fe") * (_FEO / _FE)))
        rows = named(rows, tenor=F.when((v("mode") > 0) & (v("a_s") > sulfur_limit), 100 * v("nisul") / F.when(v("mode") > 0, v("mode"))))
    feo, fe2o3 = split_iron(v("left"), ratio)
    rows = named(rows, feo=feo, fe2o3=fe2o3)
    total = oxides + v("feo") + v("fe2o3")
    rows = named(rows, again=F.when(total > 0, 100 / F.when(total > 0, total)).otherwise(1.0))
    odd = (v("a_MgO") * v("again") > MOST_MGO) | ((v("feo") + v("fe2o3")) * v("again") > MOST_IRON)
    status = F.coalesce(v("gate"), F.when(odd, "implausible"), F.when(v("mode") > MOST_SULFIDE, "sulfide"), F.lit("ok"))
    rows = named(rows, status=status)
    reached, fine = v("gate").isNull(), v("status") == "ok"
    out = {f"{o}_anhyd": F.when(reached, v(f"a_{o}")).otherwise(0.0) for o in OXIDES} | {"FeOT_anhyd": F.when(reached, v("a_iron")).otherwise(0.0)}
    out |= {f"{o}_recalc": F.when(fine, v(f"a_{o}") * v("again")).otherwise(0.0) for o in OXIDES}
    out |= {"FeO_recalc": F.when(fine, v("feo") * v("again")).otherwise(0.0), "Fe2O3_recalc": F.when(fine, v("fe2o3") * v("again")).otherwise(0.0)}
    out |= {n: F.when(reached, v(k)) for n, k in (("sulfide_mode", "mode"), ("fe_sulfide", "fe"), ("ni_silicate", "nisil"), ("ni_sulfide", "nisul"), ("sulfide_method", "method"))}
    out |= {"ni_tenor": F.when(reached & (v("tenor") <= MOST_TENOR), v("tenor")), "negative_iron": reached & F.coalesce(v("negative"), F.lit(False)), "high_tenor": reached & F.coalesce(v("tenor") > MOST_TENOR, F.lit(False)), "recalc_status": v("status")}
    return rows.withColumns(out).drop(*temp)


def recalculation_summary(df: DataFrame) -> DataFrame:
    """(rows, ok, volatile, incomplete, low_total, implausible, sulfide, negative_iron, high_tenor): counts of recalculated rows."""
    n = lambda c: F.count(F.when(c, 1))
    told = {s.replace(" ", "_"): F.col("recalc_status") == s for s in ("ok", "volatile", "incomplete", "low total", "implausible", "sulfide")}
    return df.agg(F.count("*").alias("rows"), *[n(c).alias(k) for k, c in told.items()], n(F.col("negative_iron")).alias("negative_iron"), n(F.col("high_tenor")).alias("high_tenor"))


def recalculation_clr(df: DataFrame) -> DataFrame:
    """Centred log-ratios ``clr_<oxide>_recalc`` of the recalculated oxides; null where one of them is not positive."""
    parts = [f"{o}_recalc" for o in (*OXIDES, "FeO", "Fe2O3")]
    whole = reduce(lambda a, b: a & b, [F.col(p) > 0 for p in parts])
    safe = df.withColumns({f"__{p}": F.when(whole, F.col(p)) for p in parts})
    made = clr(safe, [f"__{p}" for p in parts])
    return made.withColumnsRenamed({f"clr___{p}": f"clr_{p}" for p in parts}).drop(*[f"__{p}" for p in parts])
