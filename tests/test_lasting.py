"""Tables that are kept for a while: where they are, and what goes with them."""

import os
import subprocess
import sys
import textwrap

from pyspark.sql import functions as F

from tallyhouse.functions import lasting


def test_scratch_tables_go(spark):
    with lasting.Scratch(spark) as scratch:
        one, two = (scratch.keep(spark.range(n)) for n in (3, 4))
        scratch.drop(one)
        assert two.count() == 4 and not lasting.exists(spark, f"{scratch.path}/1")
    assert not lasting.exists(spark, scratch.path)


def test_settings_come_back(spark):
    for before in (None, "false", "true"):
        if before is None:
            spark.conf.unset(lasting._CLEANUP)
        else:
            spark.conf.set(lasting._CLEANUP, before)
        was = spark.conf.get(lasting._CLEANUP, None)
        assert lasting.lasting(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()).count() == 3
        assert spark.conf.get(lasting._CLEANUP, None) == was
    spark.conf.unset(lasting._CLEANUP)


def test_nothing_stays_behind(tmp_path):
    """Shuffle files go with the query that wrote a table, tables with the application."""
    code = f"""
    import glob
    from pyspark.sql import SparkSession, functions as F
    from tallyhouse.functions.lasting import lasting
    spark = SparkSession.builder.master("local[2]").config("spark.local.dir", "{tmp_path}/local").config("spark.checkpoint.dir", "{tmp_path}/shared").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    kept = lasting(spark.range(10000).groupBy((F.col("id") % 100).alias("k")).count())
    print(len(glob.glob("{tmp_path}/local/**/shuffle_*.data", recursive=True)))
    assert kept.count() == 100 and glob.glob("{tmp_path}/shared/*/*/*.parquet")
    spark.stop()
    """
    ran = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=240, env=os.environ)
    assert ran.returncode == 0 and ran.stdout.split() == ["0"], ran.stderr[-2000:]
    assert not list((tmp_path / "shared").glob("*/*"))
