"""Learned classification of paragraphs with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("page_id", "variant")
GROUPS = {"heading": "h1 h2 h3 h4 h5 h6", "list": "li ul ol dl dt dd", "table": "table tr td th", "quote": "blockquote q", "code": "pre code", "nav": "nav menu", "side": "aside footer header", "article": "article main section", "para": "p"}
BASE = ["log_len", "log_words", "stopword_density", "link_density", "is_heading", "position", "ends_sentence", "word_length", "not_boilerplate", "cf_good", "cf_neargood", "cf_short", "log_depth", *(f"in_{g}" for g in GROUPS)]
NEIGHBOUR = ["log_len", "stopword_density", "link_density"]


def features(rows: DataFrame, neighbour_flag: str = "cf_neargood") -> DataFrame:
    """Adds the paragraph's own features and those of its neighbours on the page. Rows are segmentation's, which has no blank paragraphs.

    neighbour_flag: the fourth feature of a neighbour, cf_neargood or not_boilerplate.
    """
    w = Window.partitionBy(*KEY).orderBy("idx")
    flag = lambda c: c.cast("double")
    tags = F.split("dom_path", "\\.")
    rows = rows.withColumns(
        {
            "log_len": F.log1p("length"),
            "log_words": F.log1p("words"),
            "is_heading": flag(F.col("heading")),
            "position": (F.row_number().over(w) - 1) / F.greatest(F.lit(1), F.count("*").over(Window.partitionBy(*KEY)) - 1),
            "ends_sentence": flag(F.col("text").rlike("[.!?…][\"'”’)]*$")),
            "word_length": F.col("length") / F.greatest(F.lit(1), F.col("words")),
            "not_boilerplate": flag(F.col("class_type") == "good"),
            **{f"cf_{k}": flag(F.col("cf_class") == k) for k in ("good", "neargood", "short")},
            "log_depth": F.log1p(F.size(tags)),
            **{f"in_{g}": flag(F.arrays_overlap(tags, F.array(*map(F.lit, names.split())))) for g, names in GROUPS.items()},
        }
    )
    near = [*NEIGHBOUR, neighbour_flag]
    return rows.withColumns({f"{side}_{c}": f(c, 1, 0.0).over(w) for side, f in (("prev", F.lag), ("next", F.lead)) for c in near})


def columns(neighbour_flag: str = "cf_neargood") -> list[str]:
    return BASE + [f"{side}_{c}" for side in ("prev", "next") for c in (*NEIGHBOUR, neighbour_flag)]


def forest(names: list[str], label: str = "label", seed: int = 0) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=30, maxDepth=12, minInstancesPerNode=20, seed=seed)])


def char_grams(c, low: int = 3, high: int = 5):
    """Letter runs of low to high of each word between blanks, lower-cased."""
    per_word = F.transform(F.filter(F.split(F.lower(c), "\\s+"), lambda x: x != ""), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))
    grams = lambda x, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(x) - n + 1)), lambda i: F.substring(x, i, n))
    return F.flatten(F.transform(per_word, lambda x: F.flatten(F.array(*(grams(x, n) for n in range(low, high + 1))))))


def text_model(label: str = "label", bits: int = 19) -> Pipeline:
    """Over a column grams of char_grams()."""
    return Pipeline(stages=[HashingTF(inputCol="grams", outputCol="text_features", numFeatures=1 << bits), LogisticRegression(labelCol=label, featuresCol="text_features", regParam=1e-4, maxIter=20, rawPredictionCol="text_raw", probabilityCol="text_probability", predictionCol="text_prediction")])


def with_text_probability(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds tp and the neighbours' tp, 0 at a page's ends."""
    w = Window.partitionBy(*KEY).orderBy("idx")
    rows = model.transform(rows).withColumn("tp", vector_to_array("text_probability")[1])
    return rows.withColumns({"prev_tp": F.lag("tp", 1, 0.0).over(w), "next_tp": F.lead("tp", 1, 0.0).over(w)}).drop("text_features", "text_raw", "text_probability", "text_prediction")


def apply(rows: DataFrame, model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """class_type by the model's probability; preformatted text is always kept."""
    scored = model.transform(rows).withColumn("keep_probability", vector_to_array("probability")[1])
    keep = F.array_contains(F.split("dom_path", "\\."), "pre") | (F.col("keep_probability") >= threshold)
    return scored.withColumn("class_type", F.when(keep, "good").otherwise("bad")).drop("features", "rawPrediction", "probability", "prediction")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
