from pyspark.sql import functions as F

from veclode.llm import store


def test_numbers_stay(spark):
    """Rows of a frame that comes in another order each time keep the numbers they were written with."""
    mixed = spark.range(500).repartition(7).select("id", F.rand().alias("r"))
    table = store.numbered(mixed, "row")
    first, again = ({r.row: (r.id, r.r) for r in table.collect()} for _ in range(2))
    assert first == again and len(first) == 500


def test_names(spark):
    df = spark.range(1).select(F.lit(1).alias("a.b"), F.lit(2).alias("__Row"), F.lit(3).alias("c`d"))
    assert df.select(*[store.quoted(c) for c in df.columns]).columns == df.columns
    assert store.unused(df, "__row") == "__row_" and store.unused(df, "x") == "x"


def test_written_tables_are_below_the_checkpoint_folder(spark):
    df = store.written(spark.range(5))
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0] and df.count() == 5
