"""Weights, conversion factors and reference values."""

# Atomic weights, g/mol.
ATOMIC_WEIGHT = {
    "H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.086,
    "P": 30.974, "S": 32.065, "Cl": 35.453, "K": 39.098, "Ca": 40.078, "Sc": 44.956, "Ti": 47.867, "V": 50.942, "Cr": 51.996,
    "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.380, "Ga": 69.723, "Ge": 72.630,
    "As": 74.922, "Se": 78.971, "Br": 79.904, "Rb": 85.468, "Sr": 87.620, "Y": 88.906, "Zr": 91.224, "Nb": 92.906,
    "Mo": 95.960, "Ag": 107.868, "Cd": 112.411, "Sn": 118.710, "Sb": 121.760, "Te": 127.600, "I": 126.904, "Cs": 132.905,
    "Ba": 137.327, "La": 138.905, "Ce": 140.116, "Pr": 140.908, "Nd": 144.242, "Sm": 150.360, "Eu": 151.964, "Gd": 157.250,
    "Tb": 158.925, "Dy": 162.500, "Ho": 164.930, "Er": 167.259, "Tm": 168.934, "Yb": 173.045, "Lu": 174.967, "Hf": 178.490,
    "Ta": 180.948, "W": 183.840, "Re": 186.207, "Os": 190.230, "Ir": 192.217, "Pt": 195.084, "Au": 196.967, "Hg": 200.592,
    "Tl": 204.383, "Pb": 207.200, "Bi": 208.980, "Th": 232.038, "U": 238.029,
}
# Molecular weights of oxides, g/mol.
OXIDE_WEIGHT = {
    "SiO2": 60.084, "TiO2": 79.866, "Al2O3": 101.961, "Fe2O3": 159.688, "FeO": 71.844, "Fe3O4": 231.533, "MgO": 40.304,
    "CaO": 56.077, "Na2O": 61.979, "K2O": 94.196, "MnO": 70.937, "P2O5": 141.943, "Cr2O3": 151.990, "NiO": 74.692,
    "CoO": 74.932, "CuO": 79.545, "ZnO": 81.379, "BaO": 153.326, "ZrO2": 123.223, "SO3": 80.064, "H2O": 18.015,
    "CO2": 44.009, "PbO": 223.199, "V2O5": 181.880,
}
# Element, oxide, factor to the oxide, factor to the element.
ELEMENT_OXIDE = (
    ("Si", "SiO2", 2.1393, 0.4674), ("Ti", "TiO2", 1.6683, 0.5995), ("Al", "Al2O3", 1.8895, 0.5293), ("Fe", "Fe2O3", 1.4297, 0.6994),
    ("Fe", "FeO", 1.2865, 0.7773), ("Fe", "Fe3O4", 1.3820, 0.7236), ("Mg", "MgO", 1.6583, 0.6030), ("Ca", "CaO", 1.3992, 0.7147),
    ("Na", "Na2O", 1.3480, 0.7419), ("K", "K2O", 1.2046, 0.8302), ("Mn", "MnO", 1.2912, 0.7745), ("P", "P2O5", 2.2914, 0.4364),
    ("Cr", "Cr2O3", 1.4616, 0.6842), ("Ni", "NiO", 1.2725, 0.7858), ("Co", "CoO", 1.2715, 0.7865), ("Cu", "CuO", 1.2518, 0.7989),
    ("Zn", "ZnO", 1.2448, 0.8034), ("Ba", "BaO", 1.1165, 0.8957), ("Zr", "ZrO2", 1.3508, 0.7403), ("S", "SO3", 2.4972, 0.4005),
    ("Pb", "PbO", 1.0772, 0.9283), ("V", "V2O5", 1.7852, 0.5602),
)
# Iron oxides to each other; the last is that of the diagram formulas.
FEO_TO_FE2O3, FE2O3_TO_FEO, DIAGRAM_FE2O3_TO_FEO = 1.1113, 0.8998, 0.8998122
# Parts per million in one unit, and units in one part per million.
UNIT_TO_PPM = {
    "ppm": 1.0, "ppb": 0.001, "ppt": 0.000001, "wt%": 10000.0, "g/t": 1.0, "mg/kg": 1.0, "μg/g": 1.0, "ng/g": 0.001,
    "oz/t": 34.2857143, "oz/st": 34.2857143, "g/100g": 10000.0, "mg/L": 1.0, "μg/L": 0.001,
}
PPM_TO_UNIT = {
    "ppm": 1.0, "ppb": 1000.0, "ppt": 1000000.0, "wt%": 0.0001, "g/t": 1.0, "mg/kg": 1.0, "μg/g": 1.0, "ng/g": 1000.0,
    "oz/t": 0.0291667, "oz/st": 0.0291667, "g/100g": 0.0001, "mg/L": 1.0, "μg/L": 1000.0,
}
# Catalogued unit conversions.
COMMON_CONVERSIONS = (
    ("ppm", "wt%"), ("ppm", "ppb"), ("ppm", "oz/t"), ("wt%", "ppm"), ("wt%", "ppb"), ("ppb", "ppm"), ("ppb", "wt%"), ("ppb", "ppt"),
    ("ppt", "ppb"), ("ppt", "ppm"), ("oz/t", "ppm"), ("oz/t", "g/t"), ("g/t", "oz/t"), ("g/t", "wt%"), ("g/t", "ppb"),
)
# Elements and oxides with molar conversions.
MOLAR_ELEMENTS = (
    "Cu Zn Pb Ni Co Cr As Sb Au Ag Mn V Ba Sr Rb Y Zr Nb Mo W Sn Bi Th U La Ce Pr Nd Sm Eu Gd Tb Dy Ho Er Tm Yb Lu".split()
)
MOLAR_OXIDES = "SiO2 TiO2 Al2O3 Fe2O3 FeO MgO CaO Na2O K2O MnO P2O5 Cr2O3 NiO BaO ZrO2 SO3 H2O CO2".split()
# Rare earths and their groups.
RARE_EARTHS = "La Ce Pr Nd Sm Eu Gd Tb Dy Ho Er Tm Yb Lu".split()
LIGHT, MIDDLE, HEAVY = "La Ce Pr Nd".split(), "Sm Eu Gd Tb Dy".split(), "Ho Er Tm Yb Lu".split()
# Reference compositions, ppm.
STANDARDS = {
    "mcdonough-sun-1995": {
        "La": 0.237, "Ce": 0.613, "Pr": 0.0928, "Nd": 0.457, "Sm": 0.148, "Eu": 0.0563, "Gd": 0.199, "Tb": 0.0361, "Dy": 0.246,
        "Ho": 0.0546, "Er": 0.160, "Tm": 0.0247, "Yb": 0.161, "Lu": 0.0246, "Y": 1.57,
    },
    "anders-grevesse-1989": {
        "La": 0.3100, "Ce": 0.8080, "Pr": 0.1220, "Nd": 0.6000, "Sm": 0.2000, "Eu": 0.0760, "Gd": 0.2670, "Tb": 0.0493, "Dy": 0.3300,
        "Ho": 0.0755, "Er": 0.2160, "Tm": 0.0329, "Yb": 0.2200, "Lu": 0.0339,
    },
    "primitive-mantle-mcdonough-sun": {
        "La": 0.648, "Ce": 1.675, "Pr": 0.254, "Nd": 1.250, "Sm": 0.406, "Eu": 0.154, "Gd": 0.544, "Tb": 0.099, "Dy": 0.674,
        "Ho": 0.149, "Er": 0.438, "Tm": 0.068, "Yb": 0.441, "Lu": 0.0675, "Y": 4.30,
    },
    "paas-taylor-mclennan": {
        "La": 38.2, "Ce": 79.6, "Pr": 8.83, "Nd": 33.9, "Sm": 5.55, "Eu": 1.08, "Gd": 4.66, "Tb": 0.774, "Dy": 4.68,
        "Ho": 0.991, "Er": 2.85, "Tm": 0.405, "Yb": 2.82, "Lu": 0.433,
    },
}
# Upper bounds, ppm, of the classes background, 2x, 3x and 5x of pathfinder elements; above is 10x.
PATHFINDERS = {
    "Mo": (1, 2, 3, 5), "W": (1, 3, 6, 10), "Sn": (1.5, 2.5, 5, 8), "Bi": (0.1, 0.2, 0.5, 1), "Te": (0.1, 0.2, 0.5, 1),
    "As": (10, 20, 50, 100), "Sb": (1, 2, 3, 5), "Ag": (0.05, 0.1, 0.2, 0.5), "Pb": (15, 30, 60, 100), "Zn": (100, 200, 300, 500),
    "Cu": (60, 100, 200, 300), "In": (0.05, 0.1, 0.2, 0.3), "Cd": (0.1, 0.2, 0.5, 1), "Li": (15, 25, 40, 50),
    "Cs": (1.5, 4, 6, 10), "Tl": (0.5, 1, 2, 4),
}
PATHFINDER_CLASSES = ("background", "2x", "3x", "5x", "10x")
OVER_SCANDIUM, OVER_POTASSIUM = ("Zn", "Cu", "In"), ("Cs", "Tl")


def molecular_weight(species: str) -> float | None:
    """Weight of an oxide or element, spelt in any case; oxides first."""
    for table in (OXIDE_WEIGHT, ATOMIC_WEIGHT):
        if species in table:
            return table[species]
    for table in (OXIDE_WEIGHT, ATOMIC_WEIGHT):
        for name, weight in table.items():
            if name.upper() == species.upper():
                return weight
    return None
