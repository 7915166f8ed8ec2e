"""Readers and writers: delimited files with sniffed separators, decimal commas, NDJSON export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts read as missing.
NULL_TOKENS = ("", "NA", "N/A", "null", "NULL")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that splits the first lines into most columns alike; read through Spark, so any store works."""
    head = [r[0] for r in spark.read.text(path).limit(20).collect()]
    best = (0, ",")
    for sep in (",", "\t", ";", "|"):
        counts = {line.count(sep) for line in head if line.strip()}
        if len(counts) == 1 and (n := counts.pop()) > best[0]:
            best = (n, sep)
    return best[1]


def read_delimited(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """All columns as text, missing tokens as null, lines of a wrong width dropped."""
    df = spark.read.csv(path, sep=separator or sniff_separator(spark, path), header=True, mode="DROPMALFORMED")
    return df.select(*[F.when(~F.trim(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c.strip()) for c in df.columns])


def coerce_numeric(df: DataFrame, decimal: str = ".", share: float = 0.8) -> DataFrame:
    """Columns of which at least ``share`` of the known cells are numbers, as doubles; NaN and infinity become null."""
    number = {c: F.regexp_replace(F.trim(f"`{c}`"), F.lit(decimal if decimal != "." else "$^"), F.lit(".")).try_cast("double") for c in df.columns}
    row = df.agg(*[F.struct(F.count(f"`{c}`").alias("known"), F.count(number[c]).alias("fine")).alias(c) for c in df.columns]).first()
    numeric = [c for c in df.columns if row[c]["known"] and row[c]["fine"] >= share * row[c]["known"]]
    return df.withColumns({c: F.when(~F.isnan(number[c]) & (F.abs(number[c]) != float("inf")), number[c]) for c in numeric})


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


# Role patterns, tested in this order; hole ids come before sample ids.
ROLE_PATTERNS = (
    ("HoleID", r"hole.?id|bhid|^hole$|drillhole"), ("ID", r"sample|^id$|lab.?no"), ("East", r"east|^x$"), ("North", r"north|^y$"),
    ("Elevation", r"elev|^z$|^rl$"), ("Latitude", r"^lat"), ("Longitude", r"^lon"), ("From", r"^from|depth.?from"), ("To", r"^to$|depth.?to"),
)


def column_roles(columns: list[str]) -> dict[str, str]:
    """Role of each column whose name matches a pattern; the first matching role counts."""
    import re

    found = {}
    for c in columns:
        for role, pattern in ROLE_PATTERNS:
            if re.search(pattern, c.strip().lower()):
                found[c] = role
                break
    return found


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(value): the lines of a text file in an encoding, blank ones left out."""
    reader = spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").option("escape", "").option("header", False)
    return reader.schema("value string").csv(path).where("trim(value) <> ''")


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 where all lines are, else Latin-1, which reads anything."""
    return "UTF-8" if read_lines(spark, path).where(F.contains("value", F.lit("�"))).isEmpty() else "ISO-8859-1"


#: Ways to split lines, in the order they are tried: separator (a pattern for the last two) and lines to skip.
STRATEGIES = tuple((sep, skip) for skip in (0, 1, 2) for sep in (",", "\t", ";", "|")) + ((r"\s{2,}", 0), (r"\s+", 0))
_HEAD_LINES = 30


def sniff_strategy(spark: SparkSession, path: str, encoding: str = "UTF-8") -> tuple[str, int]:
    """(separator, lines to skip) of the first strategy whose first lines all have as many fields as the header, two at least; of these the one with most fields.

    Skipped lines may be of another width.  Nothing that fits gives commas and no line to skip.
    """
    import csv
    import re

    head = [r[0] for r in read_lines(spark, path, encoding).limit(_HEAD_LINES).collect()]
    best = (0, (",", 0))
    for sep, skip in STRATEGIES:
        rows = [re.split(sep, line.strip()) for line in head[skip:]] if len(sep) > 1 else list(csv.reader(head[skip:], delimiter=sep))
        if len(rows) > 1 and len(rows[0]) > max(1, best[0]) and all(len(r) == len(rows[0]) for r in rows[1:]) and all(c.strip() for c in rows[0]):
            best = (len(rows[0]), (sep, skip))
        if best[0] and (skip, len(sep)) == (best[1][1], 1) and sep == "|":
            break
    return best[1]


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file of unknown encoding and separator, all columns as text: lines of another width are dropped, missing tokens are null.

    Encoding, separator and leading lines to skip are found from the file; the leading lines and the header are told
    from data by their text, as a file is split among tasks.
    """
    encoding = sniff_encoding(spark, path)
    sep, skip = sniff_strategy(spark, path, encoding)
    lines = read_lines(spark, path, encoding)
    head = [r[0] for r in lines.limit(skip + 1).collect()]
    if len(head) <= skip:
        return spark.createDataFrame([], "value string")
    if len(sep) > 1:
        fields = F.split(F.trim("value"), sep)
        names = [r for r in lines.where(F.col("value") == head[skip]).select(fields).first()[0]]
    else:
        import csv

        names = next(csv.reader([head[skip]], delimiter=sep))
        schema = ", ".join(f"c{k} string" for k in range(len(names) + 1))
        told = F.from_csv("value", F.lit(schema), {"sep": sep, "mode": "PERMISSIVE"})
        fields = F.array(*[told[f"c{k}"] for k in range(len(names) + 1)])
    rows = lines.where(~F.col("value").isin(*head)).select(fields.alias("f"))
    # Fields beyond a line's end are null; one more than the header has tells a line that is too wide.
    wide = F.size(F.filter("f", lambda x: x.isNotNull()))
    rows = rows.where(wide == len(names)) if len(sep) > 1 else rows.where(F.get("f", F.lit(len(names))).isNull())
    clean = lambda k: F.trim(F.get("f", F.lit(k)))
    return rows.select(*[F.when(~clean(k).isin(*NULL_TOKENS), clean(k)).alias(n.strip()) for k, n in enumerate(names)])


# Elements of a portable spectrometer's export, its metadata columns (in lower case) and their new names.
PXRF_ELEMENTS = tuple("Mg Al Si P S K Ca Ti V Cr Mn Fe Co Ni Cu Zn As Se Rb Sr Y Zr Nb Mo Ag Cd Sn Sb Ba La Ce Pr Nd W Hg Pb Bi Th U LE".split())
PXRF_METADATA = (
    "instrument serial num", "reading #", "reading", "shotno.", "shot", "sampleid", "sample id", "sample_id", "samplename", "sample name", "sample_name", "comment", "date", "time", "method name",
    "method", "test label", "latitude", "longitude", "lat", "long", "easting", "northing", "x", "y", "z", "elevation", "units", "project no.", "project", "sample type", "sampletype", "operator",
    "user", "notes", "description", "location", "site", "hole", "holeid", "hole id", "depth", "from", "to",
)
PXRF_NAMES = {
    "sampleid": "Sample_ID", "sample id": "Sample_ID", "sample_id": "Sample_ID", "samplename": "Sample_Name", "sample name": "Sample_Name", "sample_name": "Sample_Name", "shotno.": "Shot_No", "shot": "Shot_No",
    "reading #": "Reading_No", "reading": "Reading_No", "instrument serial num": "Instrument_SN", "method name": "Method", "method": "Method", "test label": "Test_Label", "project no.": "Project",
    "project": "Project", "sample type": "Sample_Type", "sampletype": "Sample_Type", "real time 1": "Time_Beam1", "real time 2": "Time_Beam2", "real time 3": "Time_Beam3", "holeid": "Hole_ID", "hole id": "Hole_ID", "hole": "Hole_ID",
}
_PXRF_DROPPED = (" Compound", " Compound Level", " Compound Error", " User Factor Slope", " User Factor Offset")


def is_pxrf(columns: list[str]) -> bool:
    """Whether three of the four signs of a portable spectrometer's export are there."""
    signs = (any(c.strip() == "Units" for c in columns), any(" Concentration" in c for c in columns), any(" Compound Level" in c for c in columns), any("Instrument Serial" in c for c in columns))
    return sum(signs) >= 3


def pxrf_table(df: DataFrame, below: str = "sqrt2", errors: bool = True, custom: bool = True) -> DataFrame:
    """A spectrometer's export, read as text, as ``<element>_<unit>`` and ``<element>_err`` columns beside its metadata.

    A reading below detection (``<LOD``) becomes 0, or half the element's error, or that over the root of 2, or null (``keep``); 0 where
    the error is unknown.  The unit is that of the first row which names one.  Other columns of an element go; the user's own stay as ``custom`` says.  Of columns that
    would share a name the first stays.
    """
    import re

    shares = {"zero": 0.0, "half": 0.5, "sqrt2": 0.5**0.5, "keep": None}
    if below not in shares:
        raise ValueError(f"unknown substitution {below}")
    at = {c.strip(): c for c in df.columns}
    unit = "ppm"
    if "Units" in at:
        told = F.trim(F.col(f"`{at['Units']}`").cast("string"))
        row = df.where(told != "").select(F.lower(told)).first()
        unit = row[0] if row else unit
    out: dict[str, object] = {}
    plain = lambda c: re.sub(r"[^a-zA-Z0-9]", "_", c)
    for c in df.columns:
        name, low, cell = c.strip(), c.strip().lower(), F.col(f"`{c}`").cast("string")
        element = next((e for e in PXRF_ELEMENTS if name.startswith(f"{e} ")), None)
        if element and name == f"{element} Concentration":
            number = F.trim(cell).try_cast("double")
            error = F.col(f"`{at[f'{element} Error1s']}`").try_cast("double") if f"{element} Error1s" in at else F.lit(None).cast("double")
            filled = F.lit(None).cast("double") if shares[below] is None else F.coalesce(F.when(~F.isnan(error), error) * shares[below], F.lit(0.0))
            out.setdefault(f"{element}_{unit}", F.when(F.trim(cell).startswith("<LOD"), filled).when(~F.isnan(number), number))
        elif element:
            if name == f"{element} Error1s" and errors:
                out.setdefault(f"{element}_err", F.col(f"`{c}`"))
        elif low in PXRF_METADATA or any(len(m) > 3 and m in low for m in PXRF_METADATA):
            out.setdefault(PXRF_NAMES.get(low, plain(name)), F.col(f"`{c}`"))
        elif custom and not name.endswith(_PXRF_DROPPED):
            out.setdefault(re.sub(r"[^a-zA-Z0-9_]", "_", name), F.col(f"`{c}`"))
    return df.select(*[v.alias(n) for n, v in out.items()])
