from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loomgraph.operators import classifier


def test_pairs_of_words_tell_the_labels_apart(spark):
    """Single words are alike on both sides; one label in four is 1."""
    rows = [(k, f"common w{k % 7} " + ("red green blue" if k % 4 == 0 else "green red blue"), float(k % 4 == 0), k % 5) for k in range(80)]
    known = spark.createDataFrame(rows, "doc_id long, text string, label double, fold int")
    out = classifier.fitted(known).transform(known).select("label", vector_to_array("probability")[1].alias("p"))
    assert out.where((F.col("p") >= 0.5) != (F.col("label") == 1)).count() == 0
    assert sorted((r.fold, r.auc) for r in classifier.fold_scores(known.where("fold < 2")).collect()) == [(0, 1.0), (1, 1.0)]
