"""Queries of the calculation catalogue, one for each category, over a stand-in table of analyses made from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.functions import calculations as K
from corelode.functions import chemistry as C
from corelode.functions import petrology as P
from corelode.plans.registry import ENTRIES, query, read, rounded

#: Every input of the catalogue is a column of the stand-in table; each misses a thirteenth of its values.
INPUTS = sorted({n for c in K.ALL.values() for n in c.inputs})


def analyses(spark, sf_dir: str, scale: float = 1.0) -> DataFrame:
    key = F.col("p_partkey")
    made = [
        F.when((key + 7 * k) % 13 != 0, ((key * (k + 3)) % 89 + 1).cast("double") * scale / 4.137).alias(name) for k, name in enumerate(INPUTS, 1)
    ]
    return read(spark, sf_dir, "part").select("p_partkey", *made)


def _analyses_sql(scale: float = 1.0) -> str:
    made = [f'CASE WHEN (p_partkey + {7 * k}) % 13 <> 0 THEN ((p_partkey * {k + 3}) % 89 + 1)::DOUBLE * {scale!r}::DOUBLE / 4.137 END AS "{n}"' for k, n in enumerate(INPUTS, 1)]
    return f"(SELECT p_partkey, {', '.join(made)} FROM part)"


def summary(spark, sf_dir: str, category: str, scale: float = 1.0) -> DataFrame:
    """(id, n, total, low, high) of every calculation of a category."""
    ids = [c.id for c in K.by_category(category)]
    done = K.calculate(analyses(spark, sf_dir, scale), ids)
    long = done.select(F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.col(f"`{i}`").cast("double").alias("v")) for i in ids])).alias("r")).select("r.*")
    found = long.groupBy("id").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    return rounded(found, 5)


def _summary_sql(formulas: dict[str, str], scale: float = 1.0) -> str:
    one = "SELECT '{}' AS id, count(v)::BIGINT AS n, round(sum(v), 5) AS total, round(min(v), 5) AS low, round(max(v), 5) AS high FROM (SELECT ({})::DOUBLE AS v FROM a)"
    return f"WITH a AS {_analyses_sql(scale)} " + " UNION ALL ".join(one.format(i, f) for i, f in formulas.items())


def _m(oxide: str) -> str:
    return f'("{oxide}" / {C.OXIDE_WEIGHT[oxide]})'


def _m0(oxide: str) -> str:
    return f'(coalesce("{oxide}", 0) / {C.OXIDE_WEIGHT[oxide]})'


def _z(*names: str) -> str:
    return "(" + " + ".join(f'coalesce("{n}", 0)' for n in names) + ")"


def _any(*names: str) -> str:
    return "coalesce(" + ", ".join(f'"{n}"' for n in names) + ") IS NOT NULL"


def _chain(value: str, index: str) -> str:
    bounds, below = P.CLASSES[index]
    sign = {"ge": ">=", "gt": ">"}
    return f"CASE WHEN ({value}) IS NULL THEN NULL " + " ".join(f"WHEN ({value}) {sign[how]} {bound} THEN '{name}'" for how, bound, name in bounds) + f" ELSE '{below}' END"


_UNITS = {
    "convert-ppm-to-wt": '"value" * 0.0001', "convert-ppm-to-ppb": '"value" * 1000', "convert-ppm-to-ozt": '"value" * 0.0291667',
    "convert-wt-to-ppm": '"value" * 10000', "convert-wt-to-ppb": '"value" * 10000000', "convert-ppb-to-ppm": '"value" * 0.001',
    "convert-ppb-to-wt": '"value" * 0.0000001', "convert-ppb-to-ppt": '"value" * 1000', "convert-ppt-to-ppb": '"value" * 0.001',
    "convert-ppt-to-ppm": '"value" * 0.000001', "convert-ozt-to-ppm": '"value" * 34.2857143', "convert-ozt-to-gt": '"value" * 34.2857143',
    "convert-gt-to-ozt": '"value" * 0.0291667', "convert-gt-to-wt": '"value" * 0.0001', "convert-gt-to-ppb": '"value" * 1000',
}
_MOLAR = (
    {f"ppm-to-molkg-{e.lower()}": f'"{e}" / {C.ATOMIC_WEIGHT[e]} / 1000' for e in C.MOLAR_ELEMENTS}
    | {f"wtpct-to-mol100g-{o.lower()}": f'"{o}" / {C.OXIDE_WEIGHT[o]}' for o in C.MOLAR_OXIDES}
    | {c.id: f'"{c.inputs[0]}" / {C.ATOMIC_WEIGHT[c.inputs[0]]} / 1000000' for c in K.by_category("molar") if c.id.startswith("ppb")}
)
_OXIDE = (
    {f"{e.lower()}_to_{o.lower()}": f'"{e}" * {up}' for e, o, up, _ in C.ELEMENT_OXIDE}
    | {f"{o.lower()}_to_{e.lower()}": f'"{o}" * {down}' for e, o, _, down in C.ELEMENT_OXIDE}
    | {
        "feo_to_fe2o3": '"FeO" * 1.1113', "fe2o3_to_feo": '"Fe2O3" * 0.8998',
        "calculate_feot": f'CASE WHEN {_any("FeO", "Fe2O3")} THEN coalesce("FeO", 0) + coalesce("Fe2O3", 0) * 0.8998 END',
        "calculate_fe2o3t": f'CASE WHEN {_any("FeO", "Fe2O3")} THEN coalesce("Fe2O3", 0) + coalesce("FeO", 0) * 1.1113 END',
        "ppm_to_wtpercent": '"value" / 10000', "wtpercent_to_ppm": '"value" * 10000', "ppb_to_ppm": '"value" / 1000',
    }
)
_LIME = f"least({_m0('CaO')}, {_m0('Na2O')})"
_PETRO = {
    "mg_number": f"100 * {_m('MgO')} / nullif({_m('MgO')} + {_m('FeO')}, 0)",
    "acnk": f"{_m('Al2O3')} / nullif({_m0('CaO')} + {_m0('Na2O')} + {_m0('K2O')}, 0)",
    "ank": f"{_m('Al2O3')} / nullif({_m0('Na2O')} + {_m0('K2O')}, 0)",
    "fe_number": '"FeO" / nullif("FeO" + "MgO", 0)',
    "total_alkalis": f"CASE WHEN {_any('Na2O', 'K2O')} THEN {_z('Na2O', 'K2O')} END",
    "asi": f"CASE WHEN {_m0('CaO')} - 3.34 * {_m0('P2O5')} + 2 * {_m0('Na2O')} + 2 * {_m0('K2O')} > 0 THEN 2 * {_m('Al2O3')} / ({_m0('CaO')} - 3.34 * {_m0('P2O5')} + 2 * {_m0('Na2O')} + 2 * {_m0('K2O')}) END",
}
_CIA_LIME = f"""least(CASE WHEN "P2O5" IS NULL THEN {_m0('CaO')} ELSE greatest(0, {_m0('CaO')} - 3.33 * {_m('P2O5')}) END, {_m0('Na2O')})"""
_WEATHER = {
    "cia": f"100 * {_m('Al2O3')} / nullif({_m('Al2O3')} + {_CIA_LIME} + {_m0('Na2O')} + {_m0('K2O')}, 0)",
    "ciw": f"100 * {_m('Al2O3')} / nullif({_m('Al2O3')} + {_LIME} + {_m0('Na2O')}, 0)",
    "pia": f"CASE WHEN {_m('Al2O3')} >= {_m('K2O')} THEN 100 * ({_m('Al2O3')} - {_m('K2O')}) / nullif({_m('Al2O3')} - {_m('K2O')} + {_LIME} + {_m0('Na2O')}, 0) END",
    "wip": f"CASE WHEN {_any('Na2O', 'MgO', 'K2O', 'CaO')} THEN 100 * ({_m0('Na2O')} * 2 / 0.35 + {_m0('MgO')} / 0.9 + {_m0('K2O')} * 2 / 0.25 + {_m0('CaO')} / 0.7) END",
    "icv": f"""{_z('Fe2O3', 'K2O', 'Na2O', 'CaO', 'MgO', 'MnO', 'TiO2')} / nullif("Al2O3", 0)""",
    "mwpi": f"100 * {_z('Na2O', 'K2O')} / nullif({_z('Na2O', 'K2O', 'CaO', 'MgO')}, 0)",
    "vogt": f"CASE WHEN {_any('Al2O3', 'K2O')} THEN {_z('Al2O3', 'K2O')} / nullif({_z('MgO', 'CaO', 'Na2O')}, 0) END",
    "sti": f"""100 * "SiO2" / nullif("SiO2" + {_z('TiO2', 'Fe2O3', 'Al2O3')}, 0)""",
    "ruxton_ratio": '"SiO2" / nullif("Al2O3", 0)',
}
_CHONDRITE = C.STANDARDS["mcdonough-sun-1995"]


def _norm(e: str) -> str:
    return f'("{e}" / {_CHONDRITE[e]})'


def _anomaly(e: str, a: str, b: str) -> str:
    return f"CASE WHEN {_norm(a)} > 0 AND {_norm(b)} > 0 THEN {_norm(e)} / sqrt({_norm(a)} * {_norm(b)}) END"


def _sum(*names: str) -> str:
    return f"CASE WHEN {_any(*names)} THEN {_z(*names)} END"


_REE = {f"{e.lower()}_norm_{s.replace('-', '_')}": f'"{e}" / {v[e]}' for s, v in C.STANDARDS.items() for e in C.RARE_EARTHS} | {
    "la_yb_n": f"{_norm('La')} / nullif({_norm('Yb')}, 0)", "la_sm_n": f"{_norm('La')} / nullif({_norm('Sm')}, 0)", "gd_yb_n": f"{_norm('Gd')} / nullif({_norm('Yb')}, 0)",
    "eu_anomaly": _anomaly("Eu", "Sm", "Gd"), "ce_anomaly": _anomaly("Ce", "La", "Pr"),
    "total_ree": _sum(*C.RARE_EARTHS), "lree": _sum("La", "Ce", "Pr", "Nd"), "hree": _sum("Ho", "Er", "Tm", "Yb", "Lu"),
    "lree_hree": f"({_sum('La', 'Ce', 'Pr', 'Nd')}) / nullif({_sum('Ho', 'Er', 'Tm', 'Yb', 'Lu')}, 0)",
}
_EXPLORE = {p: '"{}" / nullif("{}", 0)'.format(*(e.capitalize() for e in p.split("_"))) for p in "cu_zn pb_zn au_ag as_sb rb_sr sr_y nb_ta zr_hf th_u ba_la nb_y".split()} | {
    "cu_cu_zn": '"Cu" / nullif("Cu" + "Zn", 0)', "k_rb": '"K2O" * 8302 / nullif("Rb", 0)',
}
_FEO = '(coalesce("FeO", 0) + coalesce("Fe2O3", 0) * 0.8998122)'
_FEO_MOL = f"({_FEO} / 71.844)"
_AL = _m("Al2O3")
_DIAGRAM = {
    "alteration-index-ai": '100 * ("K2O" + "MgO") / nullif("K2O" + "MgO" + "Na2O" + "CaO", 0)',
    "alteration-index-ccpi": f'100 * ("MgO" + {_FEO}) / nullif("MgO" + {_FEO} + "Na2O" + "K2O", 0)',
    "alteration-index-aaai": '100 * "SiO2" / nullif("SiO2" + 10 * ("K2O" + "Na2O" + "CaO"), 0)',
    "molar-ratio-k-al": f"{_m('K2O')} / nullif({_AL}, 0)", "molar-ratio-na-al": f"{_m('Na2O')} / nullif({_AL}, 0)",
    "molar-ratio-nak-al": f"({_m('Na2O')} + {_m('K2O')}) / nullif({_AL}, 0)", "molar-ratio-si-al": f"{_m('SiO2')} / nullif({_AL}, 0)",
    "molar-ratio-femg-al": f"({_FEO_MOL} + {_m('MgO')}) / nullif({_AL}, 0)",
    "molar-ratio-2ca-nak-al": f"(2 * {_m('CaO')} + {_m('Na2O')} + {_m('K2O')}) / nullif({_AL}, 0)",
    "mg-number-molar": f"100 * {_m('MgO')} / nullif({_m('MgO')} + {_FEO_MOL}, 0)", "molar-ratio-ca-camg": f"{_m('CaO')} / nullif({_m('CaO')} + {_m('MgO')}, 0)",
    "ree-ratio-la-sm-n": '("La" / 0.237) / nullif("Sm" / 0.148, 0)', "ree-ratio-dy-yb-n": '("Dy" / 0.246) / nullif("Yb" / 0.161, 0)',
    "ree-eu-anomaly": '("Eu" / 0.0563) / nullif(sqrt("Sm" / 0.148 * "Gd" / 0.199), 0)', "exploration-ratio-sr-y": '"Sr" / nullif("Y", 0)',
    "exploration-ratio-la-yb": '"La" / nullif("Yb", 0)', "exploration-metal-sum-m": f"{_z('Ni', 'Cu', 'Zn', 'Pb', 'Cr')} / 10000",
    "exploration-cuni-m": f"100 * {_z('Cu', 'Ni')} / nullif({_z('Ni', 'Cu', 'Zn', 'Pb', 'Cr')}, 0)",
    "acf-a-component": '"Al2O3" / 101.96 - "K2O" / 94.2 - "Na2O" / 61.98', "acf-c-component": '"CaO" / 56.08',
    "acf-f-component": f'{_FEO} / 71.85 + "MgO" / 40.32 - "TiO2" / 79.9', "feo-total": _FEO, "total-alkalis": _z("Na2O", "K2O"),
}


def _path(value: str, e: str) -> str:
    a, b, c, d = C.PATHFINDERS[e]
    return f"CASE WHEN ({value}) IS NULL THEN NULL WHEN ({value}) <= {a} THEN 1 WHEN ({value}) <= {b} THEN 2 WHEN ({value}) <= {c} THEN 3 WHEN ({value}) <= {d} THEN 4 ELSE 5 END"


_PATH = {f"pathfinder_{e.lower()}_class": _path(f'"{e}"', e) for e in C.PATHFINDERS} | {
    f"pathfinder_{e.lower()}_{h.lower()}_class": _path(f'"{e}" / nullif("{h}", 0)', e) for h, es in (("Sc", ("Zn", "Cu", "In")), ("K", ("Cs", "Tl"))) for e in es
}
_FAMILIES = {
    "unit": (_UNITS, 1000.0), "molar": (_MOLAR, 1e6), "element-oxide": (_OXIDE, 1.0), "petrochemical": (_PETRO, 1.0), "weathering": (_WEATHER, 1.0),
    "rare-earth": (_REE, 1.0), "exploration-ratio": (_EXPLORE, 1.0), "diagram": (_DIAGRAM, 1.0), "pathfinder": (_PATH, 1.0),
}


def _register(category: str, formulas: dict[str, str], scale: float) -> None:
    name = "calculations_" + category.replace("-", "_")
    ENTRIES[name] = (lambda spark, sf_dir: summary(spark, sf_dir, category, scale), _summary_sql(formulas, scale))


for _category, (_formulas, _scale) in _FAMILIES.items():
    _register(_category, _formulas, _scale)

_ALL_SQL = _UNITS | _MOLAR | _OXIDE | _PETRO | _WEATHER | _REE | _EXPLORE | _DIAGRAM | _PATH


@query(f"WITH a AS {_analyses_sql()} " + " UNION ALL ".join(f"SELECT '{i}' AS index, class, count(*)::BIGINT AS n FROM (SELECT {_chain(_ALL_SQL[i], i)} AS class FROM a) GROUP BY class" for i in P.CLASSES))
def calculation_classes(spark, sf_dir):
    """Rows of each class of the classified indices."""
    ids = list(P.CLASSES)
    done = K.calculate(analyses(spark, sf_dir), ids)
    long = done.select(F.explode(F.array(*[F.struct(F.lit(i).alias("index"), P.classified(F.col(i), i).alias("class")) for i in ids])).alias("r")).select("r.*")
    return long.groupBy("index", "class").agg(F.count("*").alias("n"))


@query(f"""WITH a AS {_analyses_sql()} SELECT class, count(*)::BIGINT AS n FROM (SELECT CASE WHEN "Cu" IS NULL THEN 'nodata' WHEN "Cu" <= 3.5 THEN 'background'
WHEN "Cu" <= 7 THEN '2x' WHEN "Cu" <= 10.5 THEN '3x' WHEN "Cu" <= 17.5 THEN '5x' ELSE '10x' END AS class FROM a) GROUP BY class""")
def background_classes(spark, sf_dir):
    found = analyses(spark, sf_dir).select(K.background_class(F.col("Cu"), F.lit(3.5)).alias("class"))
    return found.groupBy("class").agg(F.count("*").alias("n"))
