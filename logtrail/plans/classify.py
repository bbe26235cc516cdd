"""Text models for the source and the threat of a message."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    IndexToString,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
    StringIndexer,
)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The labels, and how the models are trained.
SOURCE_LABELS = (
    "nginx_access",
    "apache_error",
    "linux_auth",
    "windows_security",
    "db_mysql",
    "db_postgres",
    "application",
)
THREAT_LABELS = ("benign", "sql_injection", "xss", "path_traversal", "command_injection")
REPLICAS = 10
INVERSE_REGULARISATION = 1.0
MAX_ITERATIONS = 1000

_TEXT, _LABEL, _PREDICTED, _ROWS = "_lt_text", "_lt_label", "_lt_predicted", "_lt_rows"


def _shares(sizes: list[tuple[str, int]], most: int) -> list[tuple[str, int, int]]:
    """Label, texts and texts to take: equal shares, and what small labels leave goes to the others; at least one."""
    out = []
    for k, (label, n) in enumerate(sorted(sizes, key=lambda s: s[1])):
        take = min(n, max(1, most // (len(sizes) - k)))
        most -= take
        out.append((label, n, take))
    return out


def _bounded(named: DataFrame, most_rows: int) -> DataFrame:
    """Different texts of each label, those with the smallest hashes, with the number of rows that each stands for."""
    texts = named.groupBy(_TEXT, _LABEL).agg(F.count("*").cast("double").alias(_ROWS)).withColumn("_lt_hash", F.xxhash64(_TEXT, _LABEL))
    sizes = [(r[0], r[1]) for r in texts.groupBy(_LABEL).count().collect()]
    shares = named.sparkSession.createDataFrame(_shares(sizes, most_rows), f"{_LABEL} string, _lt_n long, _lt_take long")
    # only about twice as many as are taken are put in order, whatever the size of a label
    near = (F.col("_lt_hash") / 2.0**63 + 1) / 2 <= (2 * F.col("_lt_take") + 100) / F.col("_lt_n")
    order = Window.partitionBy(_LABEL).orderBy("_lt_hash", _TEXT)
    ranked = texts.join(F.broadcast(shares), _LABEL).filter(near).withColumn("_lt_rank", F.row_number().over(order))
    return ranked.filter("_lt_rank <= _lt_take").select(_TEXT, _LABEL, _ROWS)


def train(corpus: DataFrame, most_rows: int = 100_000) -> PipelineModel:
    """Fit TF-IDF of words and word pairs with a multinomial logistic regression.

    ``corpus`` has ``text`` and ``label``. Terms come to the driver, all of them, so the
    labelled rows are what is bounded: of more than ``most_rows`` as many different texts
    are taken, shared among the labels, each with the weight of its rows. Every label
    keeps a text, also if there are more labels than that. Training on every text ten
    times only weakens the regularisation, so the weight is divided instead of copying rows.
    """
    named = corpus.select(F.col("text").alias(_TEXT), F.col("label").alias(_LABEL))
    named = named.withColumn(_ROWS, F.lit(1.0)) if named.count() <= most_rows else _bounded(named, most_rows)
    labels = StringIndexer(inputCol=_LABEL, outputCol="_lt_index", stringOrderType="alphabetAsc").fit(named)
    weight = 1.0 / (INVERSE_REGULARISATION * REPLICAS * max(1.0, named.agg(F.sum(_ROWS)).first()[0] or 0.0))
    stages = [
        RegexTokenizer(inputCol=_TEXT, outputCol="_lt_all", pattern=r"\b\w\w+\b", gaps=False),
        StopWordsRemover(inputCol="_lt_all", outputCol="_lt_words"),
        NGram(n=2, inputCol="_lt_words", outputCol="_lt_pairs"),
        SQLTransformer(statement="SELECT *, concat(_lt_words, _lt_pairs) AS _lt_terms FROM __THIS__"),
        CountVectorizer(inputCol="_lt_terms", outputCol="_lt_counts", vocabSize=(1 << 31) - 1, minDF=1),
        IDF(inputCol="_lt_counts", outputCol="_lt_weighted"),
        Normalizer(inputCol="_lt_weighted", outputCol="_lt_features", p=2.0),
        LogisticRegression(
            featuresCol="_lt_features",
            labelCol="_lt_index",
            weightCol=_ROWS,
            predictionCol="_lt_class",
            probabilityCol="_lt_probability",
            rawPredictionCol="_lt_raw",
            family="multinomial",
            regParam=weight,
            standardization=False,
            maxIter=MAX_ITERATIONS,
        ),
        IndexToString(inputCol="_lt_class", outputCol=_PREDICTED, labels=labels.labels),
    ]
    return Pipeline(stages=stages).fit(labels.transform(named))


def predict(df: DataFrame, model: PipelineModel, text: str, output: str) -> DataFrame:
    """Add the predicted label of the column ``text`` as ``output``."""
    scored = model.transform(df.withColumn(_TEXT, F.coalesce(text, F.lit(""))))
    return scored.select(*df.columns, F.col(_PREDICTED).alias(output))


@dataclass
class TextModels:
    """The two models; either may be missing and then gives its default label."""

    source: PipelineModel | None = None
    threat: PipelineModel | None = None

    def label(self, df: DataFrame, text: str) -> DataFrame:
        """Add ``source_label`` and ``threat_type``."""
        out = df.withColumn("source_label", F.lit("unknown")) if self.source is None else None
        out = predict(df, self.source, text, "source_label") if out is None else out
        if self.threat is None:
            return out.withColumn("threat_type", F.lit("benign"))
        return predict(out, self.threat, text, "threat_type")

    def save(self, path: str) -> None:
        for name, model in (("source", self.source), ("threat", self.threat)):
            if model is not None:
                model.write().overwrite().save(f"{path}/{name}")

    @classmethod
    def load(cls, path: str) -> TextModels:
        return cls(PipelineModel.load(f"{path}/source"), PipelineModel.load(f"{path}/threat"))


def train_models(source_corpus: DataFrame, threat_corpus: DataFrame) -> TextModels:
    return TextModels(train(source_corpus), train(threat_corpus))

