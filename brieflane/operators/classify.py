"""Quality classifier on hashed text features (K2).

Tokens are hashed into a fixed number of features, so there is no vocabulary to hold or to cut;
classes are weighted by their size; the threshold is the one that separates a validation fold best.
Folds come from the md5 of the id, which every engine has, whatever the file layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brieflane.session import cut_lineage

#: First hexadecimal digits of an id's md5: the rows that the model is measured on (3 of 16), and
#: those that the threshold is chosen on (2 of 16).
HELD_OUT, VALIDATION = ("0", "1", "2"), ("3", "4")
FEATURES, STEPS = 1 << 18, 1000


def fold_digit(id_col: str) -> Column:
    return F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 1)


def held_out(id_col: str) -> Column:
    return fold_digit(id_col).isin(*HELD_OUT)


def class_weights(train: DataFrame, label_col: str) -> Column:
    """Each class as heavy as the other: rows / (classes * rows of the class)."""
    sizes = {r[0]: r[1] for r in train.groupBy(label_col).agg(F.count("*")).collect()}  # one row a class
    whole, out = sum(sizes.values()), F.lit(1.0)
    for label, n in sizes.items():
        out = F.when(F.col(label_col) == label, F.lit(whole / (len(sizes) * n))).otherwise(out)
    return out


def best_threshold(predicted: DataFrame, label_col: str, p_col: str) -> float:
    """The threshold (in steps of 1 / STEPS) with the highest mean of both classes' hit rates on
    ``predicted``; of equals the one nearest to a half. 0.5 if a class is missing."""
    step = F.floor(F.col(p_col) * STEPS).cast("int")
    counts = predicted.groupBy(step.alias("step")).agg(F.count_if(F.col(label_col) == 1).alias("ones"),
                                                       F.count_if(F.col(label_col) == 0).alias("zeros")).collect()  # STEPS + 1 rows at most
    ones, zeros = sum(r["ones"] for r in counts), sum(r["zeros"] for r in counts)
    if not ones or not zeros:
        return 0.5
    above, below, found = ones, 0, []
    by_step = {r["step"]: r for r in counts}
    for at in range(STEPS + 1):
        found.append((above / ones + below / zeros, -abs(at / STEPS - 0.5), at / STEPS))
        if at in by_step:
            above, below = above - by_step[at]["ones"], below + by_step[at]["zeros"]
    return max(found)[2]


def quality_model(labeled: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id",
                  features: int = FEATURES):
    """Fits on the training fold, chooses the threshold on the validation fold, and returns (model,
    threshold, predictions of the held-out fold with ``p`` and ``prediction``). Rows without a label
    take no part. The features are computed once and checkpointed: a fit reads them many times."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, StopWordsRemover, Tokenizer
    from pyspark.ml.functions import vector_to_array

    data = labeled.where(F.col(label_col).isNotNull()).select(
        "*", F.col(label_col).cast("double").alias("_label"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        fold_digit(id_col).alias("_fold"))
    hashed = Pipeline(stages=[
        Tokenizer(inputCol="_text", outputCol="_words"), StopWordsRemover(inputCol="_words", outputCol="_filtered"),
        HashingTF(inputCol="_filtered", outputCol="_raw", numFeatures=features)]).fit(data).transform(data)
    hashed = cut_lineage(hashed.select(*labeled.columns, "_label", "_fold", "_raw"))
    train = hashed.where(~F.col("_fold").isin(*HELD_OUT, *VALIDATION))
    train = train.withColumn("_weight", class_weights(train, "_label"))
    model = Pipeline(stages=[
        IDF(inputCol="_raw", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=20, regParam=0.01)]).fit(train)

    def predict(fold: tuple[str, ...]) -> DataFrame:
        out = model.transform(hashed.where(F.col("_fold").isin(*fold)).withColumn("_weight", F.lit(1.0)))
        return out.withColumn("p", vector_to_array("probability")[1])

    threshold = best_threshold(predict(VALIDATION), "_label", "p")
    test = predict(HELD_OUT).withColumn("prediction", (F.col("p") >= threshold).cast("int"))
    return model, threshold, test.select(*labeled.columns, "p", "prediction")
