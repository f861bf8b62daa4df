"""Training and use of the two-model ensemble."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.functions import features as feature_functions
from barwright.schema import DEFAULT_THRESHOLD, LOOKFORWARD, MIN_TRAINING_ROWS, MODEL_THRESHOLD, SWING_THRESHOLD, features

from .impute import clean, fill, with_defaults
from .labels import swing_labels
from .trees import ROWS_A_TASK, Boosting, Forest, Trees, blocks, quantile_edges

FEW_POSITIVES = 10


def training_table(bars: DataFrame, lookforward: int = LOOKFORWARD, swing: float = SWING_THRESHOLD, how: str = "both", drop_tail: bool = False) -> DataFrame:
    """Labelled rows with all features, filled within each symbol by time (never across symbols), rows with gaps dropped."""
    names = features()
    df = swing_labels(feature_functions.all_features(bars, feature_functions.slices_for(bars)), lookforward, swing, drop_tail)
    return clean(fill(df, names, how), names).dropna(subset=[*names, "swing_label"])


def split(rows: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds is_train: `share` of each label's rows in the order of md5(seed:symbol:bar_ts); by time alone where at most one row is positive.

    A label's rows are ranked within hash cells, whose counts give the ranks before them, so no label is sorted in one task.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("symbol"), F.col("bar_ts").cast("string")).cast("binary"))
    rows = rows.withColumns({"_key": key, "_cell": F.substring(key, 1, 3)})
    cells = rows.groupBy("swing_label", "_cell").agg(F.count("*").alias("_n"))
    run = Window.partitionBy("swing_label").orderBy("_cell")
    cells = cells.select("swing_label", "_cell", (F.sum("_n").over(run) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("swing_label")).alias("_all"))
    place = F.row_number().over(Window.partitionBy("swing_label", "_cell").orderBy("_key", "symbol", "bar_ts")) + F.col("_before")
    out = rows.join(F.broadcast(cells), ["swing_label", "_cell"]).withColumn("is_train", place <= F.floor(F.col("_all") * share))
    positives = rows.where("swing_label = 1").limit(2).count()
    if positives <= 1:
        out = first_in_time(out, share)
    return out.drop("_key", "_cell", "_before", "_all")


#: A radix step tells so many bits of a number: 8,192 counts at most reach the driver a step.
RADIX = 13


def first_in_time(rows: DataFrame, share: float) -> DataFrame:
    """is_train: exactly floor(share * n) rows, the earliest by (bar_ts, symbol), of any number.

    The time at the cut is found bit by bit from the top, by counts of what the bits so far leave (one narrow pass for every 13 bits).
    Of the rows at that very time the first symbols' are taken; they are all that is sorted.
    """
    at = F.unix_micros(F.col("bar_ts").cast("timestamp")) + F.lit(1 << 62)  # no sign
    narrow = rows.select(at.alias("t"))
    left, known, bits = int(narrow.count() * share), 0, 63
    while bits:
        low = max(0, bits - RADIX)
        digit = F.shiftright("t", low).bitwiseAND((1 << bits - low) - 1)
        for r in narrow.where(F.shiftright("t", bits) == known).groupBy(digit.alias("d")).count().orderBy("d").collect():
            if left < r["count"]:
                break
            left -= r["count"]
        else:  # every row is taken
            return rows.withColumn("is_train", F.lit(True))
        known, bits = known << bits - low | r.d, low
    tied = rows.where(at == known).select("symbol", "bar_ts")
    place = F.row_number().over(Window.partitionBy("bar_ts").orderBy("symbol"))
    tied = tied.withColumn("_place", place).where(F.col("_place") <= left).select("symbol", "bar_ts", F.lit(True).alias("_tied"))
    return rows.join(tied.distinct(), ["symbol", "bar_ts"], "left").withColumn("is_train", (at < known) | F.coalesce("_tied", F.lit(False))).drop("_tied")


def scaling(rows: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, 1 for constant ones: one aggregation, one row to the driver."""
    got = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    return {c: (got[f"m_{c}"] or 0.0, got[f"s_{c}"] or 1.0) for c in names}


def scaled(rows: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()})


class Ensemble:
    """A random forest and boosted trees; the probability is their mean."""

    def __init__(self, forest: Trees, boosted: Trees, scale: dict[str, tuple[float, float]], stats: dict):
        self.forest, self.boosted, self.scale, self.stats = forest, boosted, scale, stats
        self.names = list(scale)

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        """(rows, 2): the forest's and the boosted trees' probability of a swing from raw features."""
        share = self.forest.total(values) / max(1, len(self.forest.nodes))
        return np.stack([share, 1 / (1 + np.exp(-(self.stats.get("base_margin", 0.0) + self.boosted.total(values))))], 1)

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds swing_probability and prediction (with the boosted trees' own boosted_probability); columns of the input stay as they were."""
        held = rows.sparkSession.sparkContext.broadcast((self.probabilities, len(self.names)))

        def both(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            f, width = held.value
            for v in values:
                out = f(np.stack([np.asarray(x, float) for x in v]) if len(v) else np.zeros((0, width)))
                yield pd.DataFrame({"p": out.mean(1), "boosted": out[:, 1]})

        judge = F.pandas_udf(both, "p double, boosted double")
        got = rows.withColumn("_judged", judge(F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.names))))
        p = F.col("_judged.p")
        return got.withColumns({"swing_probability": p, "boosted_probability": F.col("_judged.boosted"), "prediction": (p >= self.stats["decision_threshold"]).cast("int")}).drop("_judged")

    def importance(self, spark: SparkSession, n: int = 20) -> DataFrame:
        """The features the two models rely on most: mean of the forest's shares of impurity and the boosted trees' of mean gain."""
        both = (self.forest.importance("total") + self.boosted.importance("mean")) / 2
        rows = sorted(zip(self.names, both.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:n]
        return spark.createDataFrame(rows, "feature string, importance double")

    PARTS = ("forest", "boosted", "scale", "stats")

    def save(self, spark: SparkSession, path: str) -> None:
        """Four parts as JSON; what was at the path is replaced."""
        trees = lambda t: {"depth": t.depth, "features": t.features, "nodes": t.nodes}
        for part, content in (("forest", trees(self.forest)), ("boosted", trees(self.boosted)), ("scale", self.scale), ("stats", self.stats)):
            spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{part}")

    @classmethod
    def present(cls, spark: SparkSession, path: str) -> dict[str, bool]:
        """Which parts of a saved model are at a path."""
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        where = {p: fs.Path(f"{path}/{p}") for p in cls.PARTS}
        return {p: bool(x.getFileSystem(conf).exists(x)) for p, x in where.items()}

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        """A saved model; without its statistics, which may be missing, those that decide get their defaults."""
        read = lambda part: json.loads(spark.read.text(f"{path}/{part}", wholetext=True).first()[0])
        there = cls.present(spark, path)
        if gone := [p for p in cls.PARTS[:3] if not there[p]]:
            raise ValueError(f"no model at {path}: {', '.join(gone)} missing")
        stats = {"decision_threshold": DEFAULT_THRESHOLD, "swing_threshold": SWING_THRESHOLD, "lookforward_periods": LOOKFORWARD} | (read("stats") if there["stats"] else {})
        return cls(Trees(**read("forest")), Trees(**read("boosted")), {k: tuple(v) for k, v in read("scale").items()}, stats)


def train(
    rows: DataFrame, names: list[str] | None = None, trees: int = 250, rounds: int = 300, depths: tuple[int, int] = (10, 6), threshold: float = MODEL_THRESHOLD, seed: int = 42, min_rows: int = MIN_TRAINING_ROWS,
    lookforward: int = LOOKFORWARD, swing: float = SWING_THRESHOLD,
) -> Ensemble:
    """Fit both models on the training part of `rows`; `lookforward` and `swing` are what the rows were labelled with.

    Positives weigh double in boosting; in each bootstrap of the forest both classes weigh the same. Fewer than ten positives are
    warned of. The test part gives the scores; mean_positive_probability is the mean probability of a swing over all of it.
    """
    names = names or features()
    rows = rows.select("symbol", "bar_ts", "swing_label", *names).persist()
    parts = split(rows, seed=seed).persist()
    try:
        return _fit(parts, names, Forest(trees, depths[0], seed=seed), Boosting(rounds, depths[1], seed=seed), threshold, min_rows, {"swing_threshold": swing, "lookforward_periods": lookforward})
    finally:
        parts.unpersist()
        rows.unpersist()


def _fit(parts: DataFrame, names: list[str], forest: Forest, boosting: Boosting, threshold: float, min_rows: int, made_with: dict) -> Ensemble:
    counts = {(r.is_train, r.swing_label): r["count"] for r in parts.groupBy("is_train", "swing_label").count().collect()}
    if (total := sum(counts.values())) < min_rows:
        raise ValueError(f"{total} training rows; at least {min_rows} are needed")
    if (positives := sum(n for (_, label), n in counts.items() if label == 1)) < FEW_POSITIVES:
        warnings.warn(f"only {positives} positive rows: lower the swing threshold, use more history or look further ahead", stacklevel=3)
    fit = parts.where("is_train")
    n = {k: counts.get((True, k), 0) for k in (0, 1)}
    scale, edges = scaling(fit, names), quantile_edges(fit, names)
    base = boosting.base_margin(n[0], n[1])
    tasks = -(-sum(n.values()) // ROWS_A_TASK)
    data = blocks(fit, names, edges, tasks, margin=base)
    try:
        with ThreadPoolExecutor(2) as pool:  # rounds come one after the other and leave room for the forest beside them
            grown = pool.map(lambda m: Trees.of(m.fit(data, len(names)), edges), (forest, boosting))
            wood, boosted = grown
    finally:
        data.unpersist()
    stats = {"model_type": "forest + boosted trees", "decision_threshold": threshold, "scale_pos_weight": boosting.positive_weight, "base_margin": base, "training_samples": sum(n.values()), "test_samples": total - sum(n.values()), **made_with}
    model = Ensemble(wood, boosted, scale, stats)
    scores = {r.is_train: r for r in model.score(parts).groupBy("is_train").agg(F.avg((F.col("prediction") == F.col("swing_label")).cast("double")).alias("right"), F.avg("swing_probability").alias("p")).collect()}
    for part, name in ((True, "train_score"), (False, "test_score")):
        stats[name] = scores[part].right if part in scores else None
    stats["mean_positive_probability"] = scores[False].p if False in scores else None
    return model


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("swing_label", "prediction").agg(F.count("*").alias("n"))


def report(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each label, then the accuracy and the plain and support-weighted means of the labels.

    Everything follows from the four counts of the confusion matrix; an accuracy's precision, recall and F1 are all the accuracy.
    """
    sides = F.explode(F.array(F.lit(0), F.lit(1)))
    got = confusion(rows).withColumn("label", sides).groupBy("label").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in (("both", (F.col("swing_label") == F.col("label")) & (F.col("prediction") == F.col("label"))), ("said", F.col("prediction") == F.col("label")), ("support", F.col("swing_label") == F.col("label")))))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    got = got.withColumns({"precision": ratio("both", "said"), "recall": ratio("both", "support")})
    total = F.col("precision") + F.col("recall")
    got = got.select(F.col("label").cast("string").alias("label"), "precision", "recall", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0).alias("f1"), "support", "both")
    figures = ("precision", "recall", "f1")
    share = F.when(F.sum("support") > 0, F.sum("both") / F.sum("support")).otherwise(0.0)
    weighted = lambda c: F.when(F.sum("support") > 0, F.sum(F.col(c) * F.col("support")) / F.sum("support")).otherwise(0.0)
    means = got.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"), *(share.alias(c) for c in figures), F.sum("support").alias("support")),
            F.struct(F.lit("macro avg").alias("label"), *(F.avg(c).alias(c) for c in figures), F.sum("support").alias("support")),
            F.struct(F.lit("weighted avg").alias("label"), *(weighted(c).alias(c) for c in figures), F.sum("support").alias("support")),
        ).alias("m")
    )
    return got.drop("both").unionByName(means.select(F.explode("m").alias("m")).select("m.*"))


def prepare_for_scoring(bars: DataFrame, zeros: bool = False) -> DataFrame:
    """Features of all bars as a trained model wants them: filled, defaulted by name, nothing missing or infinite."""
    names = features()
    return clean(with_defaults(fill(feature_functions.all_features(bars, feature_functions.slices_for(bars)), names), names, zeros), names, zero_missing=True)
