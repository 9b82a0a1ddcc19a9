import os

from pyspark.sql import functions as F

from toolwarden.llm import jaccard, storage


def shuffle_files(spark):
    base = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for folder in base for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    setting = spark.conf.get(storage.CLEANUP, None)
    out = storage.kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "counted")
    assert {(r.k, r.n) for r in out.collect()} == {(k, 143 if k < 6 else 142) for k in range(7)}
    assert not shuffle_files(spark) - before
    assert spark.conf.get(storage.CLEANUP, None) == setting


def test_chosen_texts_are_moved_deflated(docs_df):
    text = " ".join(f"word{k % 50}" for k in range(2000))
    docs = docs_df([(1, text), (2, "other words that nobody asked for")])
    classes = docs.where("doc_id = 1").select(F.lit(5).cast("bigint").alias("class"), jaccard._key().alias("key"))
    (row,) = jaccard._chosen_texts(docs, classes).collect()
    assert row["class"] == 5 and len(row.text) < len(text) // 4
