"""Lines written as CSV data sets: compressed, in files of a bounded number of rows, none lost."""

import gzip
from glob import glob

from pyspark.sql import functions as F

from sylvaframe.plans import catalogue
from sylvaframe.sources import datasets

SF = "/root/testdata/sf0.001"


def test_csv_files_are_compressed_and_whole(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "_CSV_ROWS", 1000)
    columns = [*[((F.col("l_orderkey") + j) % 97).alias(f"f{j}") for j in range(54)], (F.col("l_orderkey") % 7 + 1).alias("y")]
    path = catalogue._csv_of(spark, SF, columns)
    files = glob(path.removeprefix("file:").replace("//", "/") + "/part-*")
    assert files and all(f.endswith(".csv.gz") for f in files)
    rows = [sum(1 for _ in gzip.open(f)) for f in files]
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert max(rows) <= 1000 and sum(rows) == lines.count()
    got = datasets.get_dataset("cover_type", spark, path).select("label", "features")
    want = lines.select((F.col("l_orderkey") % 7).cast("int").alias("label"), F.array(*[((F.col("l_orderkey") + j) % 97).cast("float") for j in range(54)]).alias("features"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
