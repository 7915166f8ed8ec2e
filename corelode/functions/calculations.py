"""The catalogue of derived columns: every calculation with its id, category, inputs and column builder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.functions import chemistry as C
from corelode.functions import petrology as P
from corelode.functions.petrology import or0


@dataclass(frozen=True)
class Calculation:
    id: str
    category: str
    inputs: tuple[str, ...]
    build: Callable[..., Column]


def _times(factor: float) -> Callable[[Column], Column]:
    return lambda v: v * F.lit(factor)


def _units() -> list[Calculation]:
    found = []
    for a, b in C.COMMON_CONVERSIONS:
        name = f"convert-{a}-to-{b}".replace("/", "").replace("%", "")
        found.append(Calculation(name, "unit", ("value",), lambda v, a=a, b=b: P.convert_units(v, a, b)))
    return found


def _molar() -> list[Calculation]:
    found = []
    for e in C.MOLAR_ELEMENTS:
        weight = C.ATOMIC_WEIGHT[e]
        found.append(Calculation(f"ppm-to-molkg-{e.lower()}", "molar", (e,), lambda v, w=weight: v / F.lit(w * 1000)))
    for o in C.MOLAR_OXIDES:
        found.append(Calculation(f"wtpct-to-mol100g-{o.lower()}", "molar", (o,), lambda v, w=C.OXIDE_WEIGHT[o]: v / F.lit(w)))
    for e in ("Au", "Pt", "Ir", "Os"):
        found.append(Calculation(f"ppb-to-molkg-{e.lower()}", "molar", (e,), lambda v, w=C.ATOMIC_WEIGHT[e]: v / F.lit(w * 1e6)))
    return found


def _oxides() -> list[Calculation]:
    found = []
    for e, o, up, down in C.ELEMENT_OXIDE:
        found.append(Calculation(f"{e.lower()}_to_{o.lower()}", "element-oxide", (e,), _times(up)))
        found.append(Calculation(f"{o.lower()}_to_{e.lower()}", "element-oxide", (o,), _times(down)))
    both = lambda a, b: F.coalesce(a, b).isNotNull()
    found += [
        Calculation("feo_to_fe2o3", "element-oxide", ("FeO",), _times(C.FEO_TO_FE2O3)),
        Calculation("fe2o3_to_feo", "element-oxide", ("Fe2O3",), _times(C.FE2O3_TO_FEO)),
        Calculation("calculate_feot", "element-oxide", ("FeO", "Fe2O3"), lambda a, b: F.when(both(a, b), or0(a) + or0(b) * C.FE2O3_TO_FEO)),
        Calculation("calculate_fe2o3t", "element-oxide", ("FeO", "Fe2O3"), lambda a, b: F.when(both(a, b), or0(b) + or0(a) * C.FEO_TO_FE2O3)),
        Calculation("ppm_to_wtpercent", "element-oxide", ("value",), _times(0.0001)),
        Calculation("wtpercent_to_ppm", "element-oxide", ("value",), _times(10000.0)),
        Calculation("ppb_to_ppm", "element-oxide", ("value",), _times(0.001)),
    ]
    return found


def _indices() -> list[Calculation]:
    table = {
        "petrochemical": {
            "mg_number": (P.mg_number, "MgO FeO"), "acnk": (P.acnk, "Al2O3 CaO Na2O K2O"), "ank": (P.ank, "Al2O3 Na2O K2O"),
            "fe_number": (P.fe_number, "FeO MgO"), "total_alkalis": (P.total_alkalis, "Na2O K2O"), "asi": (P.asi, "Al2O3 CaO Na2O K2O P2O5"),
        },
        "weathering": {
            "cia": (P.cia, "Al2O3 CaO Na2O K2O P2O5"), "ciw": (P.ciw, "Al2O3 CaO Na2O"), "pia": (P.pia, "Al2O3 CaO Na2O K2O"),
            "wip": (P.wip, "Na2O MgO K2O CaO"), "icv": (P.icv, "Al2O3 Fe2O3 K2O Na2O CaO MgO MnO TiO2"), "mwpi": (P.mwpi, "Na2O K2O CaO MgO"),
            "vogt": (P.vogt, "Al2O3 K2O MgO CaO Na2O"), "sti": (P.sti, "SiO2 TiO2 Fe2O3 Al2O3"), "ruxton_ratio": (P.ruxton_ratio, "SiO2 Al2O3"),
        },
    }
    return [Calculation(k, kind, tuple(names.split()), f) for kind, all_ in table.items() for k, (f, names) in all_.items()]


def normalised(value: Column, element: str, standard: str = "mcdonough-sun-1995") -> Column:
    """A rare earth over its reference value; null where the standard has none."""
    reference = C.STANDARDS[standard].get(element)
    return value / F.lit(reference) if reference else F.lit(None).cast("double")


def anomaly(value: Column, below: Column, above: Column, names: tuple[str, str, str], standard: str = "mcdonough-sun-1995") -> Column:
    """Normalised value over the geometric mean of its normalised neighbours; null unless both are positive."""
    v, a, b = (normalised(c, n, standard) for c, n in zip((value, below, above), names, strict=True))
    return F.when((a > 0) & (b > 0), v / F.sqrt(a * b))


def present_sum(*values: Column) -> Column:
    """Sum of the values there are; null where there is none."""
    return F.when(F.coalesce(*values).isNotNull(), sum((or0(c) for c in values), F.lit(0.0)))


def _rare_earths() -> list[Calculation]:
    found = [
        Calculation(f"{e.lower()}_norm_{s.replace(chr(45), chr(95))}", "rare-earth", (e,), lambda v, e=e, s=s: normalised(v, e, s)) for s in C.STANDARDS for e in C.RARE_EARTHS
    ]
    for a, b in (("La", "Yb"), ("La", "Sm"), ("Gd", "Yb")):
        ratio = lambda x, y, a=a, b=b: F.try_divide(normalised(x, a), normalised(y, b))
        found.append(Calculation(f"{a.lower()}_{b.lower()}_n", "rare-earth", (a, b), ratio))
    light, heavy = len(C.LIGHT), len(C.HEAVY)
    return [
        *found,
        Calculation("eu_anomaly", "rare-earth", ("Eu", "Sm", "Gd"), lambda *c: anomaly(*c, ("Eu", "Sm", "Gd"))),
        Calculation("ce_anomaly", "rare-earth", ("Ce", "La", "Pr"), lambda *c: anomaly(*c, ("Ce", "La", "Pr"))),
        Calculation("total_ree", "rare-earth", tuple(C.RARE_EARTHS), present_sum),
        Calculation("lree", "rare-earth", tuple(C.LIGHT), present_sum),
        Calculation("hree", "rare-earth", tuple(C.HEAVY), present_sum),
        Calculation("lree_hree", "rare-earth", (*C.LIGHT, *C.HEAVY), lambda *c: F.try_divide(present_sum(*c[:light]), present_sum(*c[-heavy:]))),
    ]


def _exploration() -> list[Calculation]:
    pairs = "cu_zn pb_zn au_ag as_sb rb_sr sr_y nb_ta zr_hf th_u ba_la nb_y".split()
    found = [Calculation(p, "exploration-ratio", tuple(e.capitalize() for e in p.split("_")), F.try_divide) for p in pairs]
    found.append(Calculation("cu_cu_zn", "exploration-ratio", ("Cu", "Zn"), lambda a, b: F.try_divide(a, a + b)))
    found.append(Calculation("k_rb", "exploration-ratio", ("K2O", "Rb"), lambda k, rb: F.try_divide(k * 8302, rb)))
    return found


def _iron(feo: Column, fe2o3: Column) -> Column:
    return or0(feo) + or0(fe2o3) * C.DIAGRAM_FE2O3_TO_FEO


def _diagrams() -> list[Calculation]:
    mol, over = P.mol, F.try_divide
    al = lambda v: mol(v, "Al2O3")
    r = {k: C.STANDARDS["mcdonough-sun-1995"][k] for k in ("La", "Sm", "Dy", "Yb", "Eu", "Gd")}
    metals = lambda *c: sum((or0(x) for x in c), F.lit(0.0))
    table = {
        "alteration-index-ai": ("K2O MgO Na2O CaO", lambda k, mg, na, ca: over(100 * (k + mg), k + mg + na + ca)),
        "alteration-index-ccpi": ("MgO FeO Fe2O3 Na2O K2O", lambda mg, a, b, na, k: over(100 * (mg + _iron(a, b)), mg + _iron(a, b) + na + k)),
        "alteration-index-aaai": ("SiO2 K2O Na2O CaO", lambda si, k, na, ca: over(100 * si, si + 10 * k + 10 * na + 10 * ca)),
        "molar-ratio-k-al": ("K2O Al2O3", lambda k, a: over(mol(k, "K2O"), al(a))),
        "molar-ratio-na-al": ("Na2O Al2O3", lambda na, a: over(mol(na, "Na2O"), al(a))),
        "molar-ratio-nak-al": ("Na2O K2O Al2O3", lambda na, k, a: over(mol(na, "Na2O") + mol(k, "K2O"), al(a))),
        "molar-ratio-si-al": ("SiO2 Al2O3", lambda si, a: over(mol(si, "SiO2"), al(a))),
        "molar-ratio-femg-al": ("FeO Fe2O3 MgO Al2O3", lambda f, g, mg, a: over(mol(_iron(f, g), "FeO") + mol(mg, "MgO"), al(a))),
        "molar-ratio-2ca-nak-al": ("CaO Na2O K2O Al2O3", lambda ca, na, k, a: over(2 * mol(ca, "CaO") + mol(na, "Na2O") + mol(k, "K2O"), al(a))),
        "mg-number-molar": ("MgO FeO Fe2O3", lambda mg, f, g: over(100 * mol(mg, "MgO"), mol(mg, "MgO") + mol(_iron(f, g), "FeO"))),
        "molar-ratio-ca-camg": ("CaO MgO", lambda ca, mg: over(mol(ca, "CaO"), mol(ca, "CaO") + mol(mg, "MgO"))),
        "ree-ratio-la-sm-n": ("La Sm", lambda a, b: over(a / r["La"], b / r["Sm"])),
        "ree-ratio-dy-yb-n": ("Dy Yb", lambda a, b: over(a / r["Dy"], b / r["Yb"])),
        "ree-eu-anomaly": ("Eu Sm Gd", lambda e, s, g: over(e / r["Eu"], F.sqrt(s / r["Sm"] * g / r["Gd"]))),
        "exploration-ratio-sr-y": ("Sr Y", over),
        "exploration-ratio-la-yb": ("La Yb", over),
        "exploration-metal-sum-m": ("Ni Cu Zn Pb Cr", lambda *c: metals(*c) / 10000),
        "exploration-cuni-m": ("Cu Ni Zn Pb Cr", lambda cu, ni, *c: over(100 * (or0(cu) + or0(ni)), metals(cu, ni, *c))),
        "acf-a-component": ("Al2O3 K2O Na2O", lambda a, k, na: a / 101.96 - k / 94.2 - na / 61.98),
        "acf-c-component": ("CaO", lambda ca: ca / 56.08),
        "acf-f-component": ("FeO Fe2O3 MgO TiO2", lambda f, g, mg, ti: _iron(f, g) / 71.85 + mg / 40.32 - ti / 79.9),
        "feo-total": ("FeO Fe2O3", _iron),
        "total-alkalis": ("Na2O K2O", lambda na, k: or0(na) + or0(k)),
    }
    return [Calculation(k, "diagram", tuple(names.split()), f) for k, (names, f) in table.items()]


def pathfinder_class(value: Column, element: str) -> Column:
    """1 for background, 2 to 5 for the classes above it; null without a value."""
    out = F.when(value.isNull() | F.isnan(value), None)
    for k, bound in enumerate(C.PATHFINDERS[element], 1):
        out = out.when(value <= bound, k)
    return out.otherwise(5)


def background_class(value: Column, background: Column) -> Column:
    """The class name of a value as a multiple of its background (1, 2, 3 and 5 times); nodata without either."""
    out = F.when(value.isNull() | F.isnan(value) | background.isNull() | ~(background > 0), "nodata")
    for k, name in zip((1, 2, 3, 5), C.PATHFINDER_CLASSES, strict=False):
        out = out.when(value <= k * background, name)
    return out.otherwise(C.PATHFINDER_CLASSES[-1])


def _pathfinders() -> list[Calculation]:
    found = [Calculation(f"pathfinder_{e.lower()}_class", "pathfinder", (e,), lambda v, e=e: pathfinder_class(v, e)) for e in C.PATHFINDERS]
    for host, elements in (("Sc", C.OVER_SCANDIUM), ("K", C.OVER_POTASSIUM)):
        for e in elements:
            build = lambda v, h, e=e: pathfinder_class(F.try_divide(v, h), e)
            found.append(Calculation(f"pathfinder_{e.lower()}_{host.lower()}_class", "pathfinder", (e, host), build))
    return found


ALL: dict[str, Calculation] = {
    c.id: c for c in [*_units(), *_molar(), *_oxides(), *_indices(), *_rare_earths(), *_exploration(), *_diagrams(), *_pathfinders()]
}


def by_category(category: str) -> list[Calculation]:
    return [c for c in ALL.values() if c.category == category]


def category_counts() -> dict[str, int]:
    return {k: len(by_category(k)) for k in dict.fromkeys(c.category for c in ALL.values())}


def calculate(df: DataFrame, ids: list[str], mapping: dict[str, str] | None = None) -> DataFrame:
    """``df`` with one column for each calculation; ``mapping`` names the column of an input, else its own name.

    An input without a column counts as missing in every row.
    """
    names = mapping or {}

    def column(name: str) -> Column:
        own = names.get(name, name)
        return F.col(own).cast("double") if own in df.columns else F.lit(None).cast("double")

    return df.select("*", *[ALL[i].build(*(column(n) for n in ALL[i].inputs)).alias(i) for i in ids])


def auto_mapping(columns: list[str], ids: list[str]) -> dict[str, str]:
    """For each input of ``ids`` the first column whose name is the symbol, alone or followed by a unit, in any case."""
    found = {}
    for name in dict.fromkeys(n for i in ids for n in ALL[i].inputs):
        for c in columns:
            if c.lower() == name.lower() or c.lower().replace("-", "_").replace(" ", "_").split("_")[0] == name.lower():
                found[name] = c
                break
    return found
