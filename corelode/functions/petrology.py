"""Petrochemical and weathering indices as null-safe column expressions; inputs in weight percent unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corelode.functions.chemistry import OXIDE_WEIGHT, PPM_TO_UNIT, UNIT_TO_PPM


def convert_units(value: Column, source: str, target: str) -> Column:
    """Through parts per million."""
    return value * F.lit(UNIT_TO_PPM[source] * PPM_TO_UNIT[target])


def mol(value: Column, oxide: str) -> Column:
    return value / F.lit(OXIDE_WEIGHT[oxide])


def or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _base(value: Column, oxide: str) -> Column:
    """Molar amount of a base; a missing one counts as none."""
    return mol(or0(value), oxide)


def mg_number(mgo: Column, feo: Column) -> Column:
    m, f = mol(mgo, "MgO"), mol(feo, "FeO")
    return F.try_divide(100 * m, m + f)


def acnk(al: Column, ca: Column, na: Column, k: Column) -> Column:
    return F.try_divide(mol(al, "Al2O3"), _base(ca, "CaO") + _base(na, "Na2O") + _base(k, "K2O"))


def ank(al: Column, na: Column, k: Column) -> Column:
    return F.try_divide(mol(al, "Al2O3"), _base(na, "Na2O") + _base(k, "K2O"))


def fe_number(feo_total: Column, mgo: Column) -> Column:
    return F.try_divide(feo_total, feo_total + mgo)


def silicate_lime(ca: Column, p: Column, na: Column) -> Column:
    """Molar CaO without apatite's, never negative, no more than Na2O."""
    return F.least(F.when(p.isNull(), _base(ca, "CaO")).otherwise(F.greatest(F.lit(0.0), _base(ca, "CaO") - 3.33 * mol(p, "P2O5"))), _base(na, "Na2O"))


def cia(al: Column, ca: Column, na: Column, k: Column, p: Column) -> Column:
    a = mol(al, "Al2O3")
    return F.try_divide(100 * a, a + silicate_lime(ca, p, na) + _base(na, "Na2O") + _base(k, "K2O"))


def ciw(al: Column, ca: Column, na: Column) -> Column:
    """Lime no more than soda."""
    a, n = mol(al, "Al2O3"), _base(na, "Na2O")
    return F.try_divide(100 * a, a + F.least(_base(ca, "CaO"), n) + n)


def pia(al: Column, ca: Column, na: Column, k: Column) -> Column:
    """Null where potash exceeds alumina."""
    rest, n = mol(al, "Al2O3") - mol(k, "K2O"), _base(na, "Na2O")
    return F.when(rest >= 0, F.try_divide(100 * rest, rest + F.least(_base(ca, "CaO"), n) + n))


def total_alkalis(na: Column, k: Column) -> Column:
    return F.when(na.isNotNull() | k.isNotNull(), or0(na) + or0(k))


def asi(al: Column, ca: Column, na: Column, k: Column, p: Column) -> Column:
    """Aluminium saturation; null where the bases left after apatite are not positive."""
    bases = _base(ca, "CaO") - 2 * 1.67 * _base(p, "P2O5") + 2 * _base(na, "Na2O") + 2 * _base(k, "K2O")
    return F.when(bases > 0, 2 * mol(al, "Al2O3") / bases)


def wip(na: Column, mg: Column, k: Column, ca: Column) -> Column:
    parts = 2 * _base(na, "Na2O") / 0.35 + _base(mg, "MgO") / 0.9 + 2 * _base(k, "K2O") / 0.25 + _base(ca, "CaO") / 0.7
    return F.when(F.coalesce(na, mg, k, ca).isNotNull(), 100 * parts)


def icv(al: Column, *others: Column) -> Column:
    """Fe2O3, K2O, Na2O, CaO, MgO, MnO and TiO2, missing ones as none, over alumina."""
    return F.try_divide(sum((or0(c) for c in others), F.lit(0.0)), al)


def mwpi(na: Column, k: Column, ca: Column, mg: Column) -> Column:
    alkalis = or0(na) + or0(k)
    return F.try_divide(100 * alkalis, alkalis + or0(ca) + or0(mg))


def vogt(al: Column, k: Column, mg: Column, ca: Column, na: Column) -> Column:
    return F.when(F.coalesce(al, k).isNotNull(), F.try_divide(or0(al) + or0(k), or0(mg) + or0(ca) + or0(na)))


def sti(si: Column, ti: Column, fe: Column, al: Column) -> Column:
    return F.try_divide(100 * si, si + or0(ti) + or0(fe) + or0(al))


def ruxton_ratio(si: Column, al: Column) -> Column:
    return F.try_divide(si, al)


def banded(value: Column, bands: list[tuple[float, str]], above: str) -> Column:
    """The label of the first band whose upper bound holds the value; null stays null."""
    out = F.when(value.isNull(), None)
    for bound, label in bands:
        out = out.when(value <= bound, label)
    return out.otherwise(above)


# Lower bounds with "ge" or "gt", their class, and the class below all.
CLASSES = {
    "mg_number": ((("ge", 70, "Primitive (≥70)"), ("ge", 50, "Intermediate (50-70)")), "Evolved (<50)"),
    "acnk": ((("gt", 1.0, "Peraluminous (>1.0)"), ("ge", 0.9, "Metaluminous (0.9-1.0)")), "Peralkaline (<0.9)"),
    "ank": ((("ge", 1.0, "Subalkaline"),), "Peralkaline"),
    "fe_number": ((("ge", 0.65, "Tholeiitic (≥0.65)"),), "Calc-alkaline (<0.65)"),
    "cia": ((("ge", 85, "Extreme weathering (≥85)"), ("ge", 65, "Moderate weathering (65-85)"), ("ge", 50, "Low weathering (50-65)")), "Fresh rock (<50)"),
    "asi": ((("gt", 1.1, "Strongly Peraluminous (>1.1)"), ("gt", 1.0, "Peraluminous (1.0-1.1)")), "Metaluminous (≤1.0)"),
    "wip": ((("ge", 80, "Fresh rock (≥80)"), ("ge", 60, "Low weathering (60-80)"), ("ge", 40, "Moderate weathering (40-60)")), "Intense weathering (<40)"),
    "icv": ((("gt", 1, "First-cycle sediment (>1)"),), "Recycled/weathered (<1)"),
    "ruxton_ratio": ((("gt", 10, "Fresh rock (>10)"), ("gt", 5, "Moderate weathering (5-10)")), "Intense weathering (<5)"),
    "eu_anomaly": ((("gt", 1.15, "Positive Eu anomaly - plagioclase accumulation"), ("ge", 0.85, "No significant Eu anomaly")), "Negative Eu anomaly - plagioclase fractionation"),
    "ce_anomaly": ((("gt", 1.1, "Positive Ce anomaly"), ("ge", 0.9, "No significant Ce anomaly")), "Negative Ce anomaly - oxidizing conditions"),
    "cu_zn": ((("gt", 1, "Cu-dominant - closer to feeder zone"),), "Zn-dominant - distal/peripheral"),
    "au_ag": ((("gt", 0.1, "Au-rich (orogenic gold type)"), ("gt", 0.01, "Au-Ag (epithermal type)")), "Ag-rich (polymetallic type)"),
    "rb_sr": ((("gt", 0.5, "Highly evolved/fractionated"), ("gt", 0.1, "Moderately evolved")), "Primitive/less evolved"),
    "sr_y": ((("gt", 40, "Adakitic signature (Sr/Y > 40)"), ("gt", 20, "High Sr/Y - partial adakitic")), "Normal arc signature"),
    "nb_ta": ((("gt", 20, "Super-chondritic - rutile involvement"), ("ge", 14, "Near chondritic (~17)")), "Sub-chondritic - titanite/ilmenite"),
    "th_u": ((("gt", 4, "Crustal signature"), ("ge", 2, "Average crustal")), "Mantle-like or U-enriched"),
}


def classified(value: Column, index: str) -> Column:
    """The class of an index's value; null stays null."""
    bounds, below = CLASSES[index]
    out = F.when(value.isNull(), None)
    for how, bound, label in bounds:
        out = out.when(value >= bound if how == "ge" else value > bound, label)
    return out.otherwise(below)
