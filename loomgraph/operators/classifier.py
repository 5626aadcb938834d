"""A text classifier by TF-IDF of single words and pairs, and balanced logistic regression, fitted by MLlib.

Terms are counted by a plain aggregate, and each text becomes a vector of counts once, written before MLlib reads it
again and again. Of equally frequent terms at the end of the vocabulary the smallest count.
"""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import written

#: Words and pairs of words that are features: the most frequent ones.
FEATURES = 5000
#: What makes `terms` of `text`: words of two characters or more in lower case, and each two that follow one another.
TERMS = [
    r"SELECT *, regexp_extract_all(lower(text), '\\w\\w+', 0) AS words FROM __THIS__",
    "SELECT *, concat(words, zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, greatest(size(words) - 1, 0)), (a, b) -> concat(a, ' ', b))) AS terms FROM __THIS__",
]


def _terms() -> list[SQLTransformer]:
    return [SQLTransformer(statement=sql) for sql in TERMS]


def _term_counts(known: DataFrame, **counts: Column) -> DataFrame:
    """(term, counts) of the terms of known."""
    # not explode: it would be given a filter that makes the terms another time
    terms = PipelineModel(_terms()).transform(known).withColumn("term", F.explode_outer("terms")).where("term IS NOT NULL")
    return terms.groupBy("term").agg(*(c.alias(n) for n, c in counts.items()))


def _most_frequent(counts: DataFrame, n: Column, features: int) -> list[str]:
    return [r.term for r in counts.select("term", n.alias("n")).where("n > 0").orderBy(F.desc("n"), "term").limit(features).collect()]


def _vectorizer(vocabulary: list[str]) -> list[Model]:
    """Stages that add `counts` of the vocabulary to rows (text)."""
    return [*_terms(), CountVectorizerModel.from_vocabulary(vocabulary or [""], inputCol="terms", outputCol="counts")]


def _fitted_counts(known: DataFrame, iterations: int, counts: str = "counts") -> list[Model]:
    """Stages that add `probability` to rows (counts), of known (counts, label), in which both labels weigh alike."""
    rows = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    weight = F.coalesce(*(F.when(F.col("label") == k, sum(rows.values()) / (len(rows) * n)) for k, n in rows.items()), F.lit(1.0))
    idf = IDF(inputCol=counts, outputCol="features").fit(known)
    return [idf, LogisticRegression(maxIter=iterations, regParam=0.01, weightCol="weight").fit(idf.transform(known.withColumn("weight", weight)))]


def fitted(known: DataFrame, features: int = FEATURES, iterations: int = 50) -> PipelineModel:
    """A model of known (text, label 0.0 or 1.0), in which both labels weigh alike. It adds `probability` to rows (text)."""
    terms = _vectorizer(_most_frequent(_term_counts(known, n=F.count("*")), F.col("n"), features))
    counts = written(PipelineModel(terms).transform(known).select("label", "counts"))
    return PipelineModel([*terms, *_fitted_counts(counts, iterations)])


def scores(docs: DataFrame, labels: DataFrame, features: int = FEATURES, iterations: int = 50) -> DataFrame:
    """docs (doc_id, text) without text but with `probability`, by a model of those that have labels (doc_id, label)."""
    vocabulary = _most_frequent(_term_counts(docs.join(labels, "doc_id"), n=F.count("*")), F.col("n"), features)
    counts = written(PipelineModel(_vectorizer(vocabulary)).transform(docs).select("doc_id", "counts"))
    return PipelineModel(_fitted_counts(counts.join(labels, "doc_id"), iterations)).transform(counts)


def fold_scores(known: DataFrame, features: int = FEATURES, iterations: int = 50) -> DataFrame:
    """(fold, auc) of known (text, label, fold): each fold is scored by a model of the others.

    Terms are counted by fold once. Vectors have the terms of all vocabularies; to a model those outside its own are 0.
    """
    measure = BinaryClassificationEvaluator(metricName="areaUnderROC")
    folds = sorted(r.fold for r in known.select("fold").distinct().collect())  # a few
    terms = written(_term_counts(known, **{f"n{k}": F.count_if(F.col("fold") != k) for k in folds}))
    own = {k: set(_most_frequent(terms, F.col(f"n{k}"), features)) for k in folds}
    union = sorted(set().union(*own.values()))
    counts = written(PipelineModel(_vectorizer(union)).transform(known).select("label", "fold", "counts"))
    rows = []
    for k in folds:
        masked = ElementwiseProduct(scalingVec=Vectors.dense([float(t in own[k]) for t in union] or [0.0]), inputCol="counts", outputCol="own").transform(counts)
        model = PipelineModel(_fitted_counts(masked.where(F.col("fold") != k), iterations, "own"))
        rows.append((int(k), float(measure.evaluate(model.transform(masked.where(F.col("fold") == k))))))
    return known.sparkSession.createDataFrame(rows, "fold int, auc double")
