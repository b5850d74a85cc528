"""The rows that the quality classifier learns from."""

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm import quality_model


def test_repeated_rows_of_an_id_are_one(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    plain = quality_model.fit(docs, labels)
    hot = labels.filter("quality = 1").select("doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).first()[0]
    more = docs.filter(F.col("doc_id") == hot).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(400))).alias("n"), "text")
    repeated = docs.unionByName(more.select("doc_id", F.when(F.col("n") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" later"))).alias("text"))).unionByName(more.select("doc_id", F.lit(None).cast("string").alias("text")))
    again = quality_model.fit(repeated, labels)
    for a, b in zip(vars(plain).values(), vars(again).values(), strict=True):
        assert np.array_equal(a, b)
