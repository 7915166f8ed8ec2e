import pytest
from pyspark.sql import functions as F

from corelode.functions import formula
from corelode.sources import tables
from corelode.streaming import control


@pytest.mark.parametrize(("text", "want"), [("2^3^2", 64.0), ("-2^2", 4.0), ("1/0", None), ("log(100)", 2.0), ("sqrt(-1)", None), ("min(1,2)", 1.0), ("1+2*3", 7.0), ("{a b}*2", 6.0), ("ln(0)", None)])
def test_formula(spark, text, want):
    df = spark.createDataFrame([(3.0,)], ["a b"])
    assert df.select(formula.compile_formula(text)).first()[0] == want


@pytest.mark.parametrize("text", ["--1", "1e5", "1+", "(1", "min(1)", "foo(1)", "1 $ 2"])
def test_formula_errors(spark, text):
    with pytest.raises(ValueError):
        formula.compile_formula(text)


def test_variables(spark):
    assert formula.variables("{a b}+c*c") == ["a b", "c"]


def test_censored(spark):
    df = spark.createDataFrame([(t,) for t in ("<0.5", ">100", "BDL", "12abc", "", "-", "1.5e2", None, "x")], "t string")
    assert [r[0] for r in df.select(formula.parse_censored(F.col("t"))).collect()] == [0.25, 100.0, None, 12.0, None, None, 150.0, None, None]


def test_delimited_and_roles(spark, tmp_path):
    (tmp_path / "a.csv").write_text("HoleID;From;Note\nA;1,5;x\nB;NA;y\nC;2,5;12\n")
    df = tables.coerce_numeric(tables.read_delimited(spark, str(tmp_path / "a.csv")), decimal=",")
    assert [tuple(r) for r in df.collect()] == [("A", 1.5, "x"), ("B", None, "y"), ("C", 2.5, "12")]
    assert tables.column_roles(["HoleID", "SampleID", "EASTING", "From"]) == {"HoleID": "HoleID", "SampleID": "ID", "EASTING": "East", "From": "From"}


def test_stream(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    limits = events.groupBy("event_type").agg(F.avg("value").alias("centre"), F.stddev_samp("value").alias("sd"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = control.failures_by_window(control.chart_status(stream, limits, "event_type", "value"), "ts", "event_type")
    query = out.writeStream.outputMode("complete").format("memory").queryName("chart").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(count) from chart").first()[0] == events.count()
