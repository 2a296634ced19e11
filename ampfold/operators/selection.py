"""Recursive feature elimination with cross-validation (RFE-CV) as a Spark ML Estimator / Model.

Per fold (thread pool, each fit a distributed forest job): start from all features; fit; score
the held-out rows (negative MSE on the scaled target); drop the ``step`` least important
features (ties: lower index first); repeat down to ``minFeatures``. The mean score per feature
count picks the size (the smaller size on ties). A final elimination on all rows down to that
size gives the mask and the ranking (1 = selected; a feature dropped k rounds before the end
has rank k + 1). Only importances and scores (model-sized numbers) reach the driver.

With a ``ledger`` folder (in shared storage) every step of every fold is written down there: the feature count, its score
and the features that go on. A driver that starts again on the same rows and settings takes up each fold where it stopped.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampfold.operators.modeling import PRESETS, forest, with_folds

#: The fold number of the last elimination, on all rows.
ALL_ROWS = -1


class Ledger:
    """The steps of an elimination so far, one small table each: fold, feature count, score, features that go on."""

    SCHEMA = "fold int, size int, score double, kept array<int>"

    def __init__(self, spark: SparkSession, path: str | None, run: str):
        self.spark, self.run, self.path = spark, run, path and f"{path.rstrip('/')}/run-{run}"
        self.known: dict[tuple[int, int], tuple[float | None, list[int]]] = {}
        if self.path and self._exists():
            rows = spark.read.schema(self.SCHEMA).option("recursiveFileLookup", True).parquet(self.path).collect()
            self.known = {(r["fold"], r["size"]): (r["score"], list(r["kept"])) for r in rows}

    def _exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def step(self, fold: int, size: int, make) -> tuple[float | None, list[int]]:
        """The score at ``size`` features and those that go on: as written down, or made and written down."""
        if (fold, size) not in self.known:
            score, kept = make()
            if self.path:
                row = self.spark.createDataFrame([(fold, size, score, kept)], self.SCHEMA).coalesce(1)
                row.write.mode("overwrite").parquet(f"{self.path}/step-{fold}-{size}")
            self.known[fold, size] = score, kept
        return self.known[fold, size]


class _RFEParams(HasFeaturesCol, HasLabelCol, HasOutputCol):
    step = Param(Params._dummy(), "step", "features removed per round (>=1) or fraction (0,1)", TypeConverters.toFloat)
    minFeatures = Param(Params._dummy(), "minFeatures", "smallest feature count", TypeConverters.toInt)
    folds = Param(Params._dummy(), "folds", "'loo' or number of folds", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "row id used for fold assignment", TypeConverters.toString)
    numTrees = Param(Params._dummy(), "numTrees", "trees per forest", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "tree depth", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "forest seed", TypeConverters.toInt)
    parallelism = Param(Params._dummy(), "parallelism", "folds fitted concurrently", TypeConverters.toInt)
    ledger = Param(Params._dummy(), "ledger", "shared folder of the steps so far ('': none)", TypeConverters.toString)


class RecursiveFeatureElimination(Estimator, _RFEParams, DefaultParamsReadable, DefaultParamsWritable):
    """``labelCol`` is the (already scaled) regression target; ``featuresCol`` a vector."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "_target", outputCol: str = "selected",
                 step: float = 1.0, minFeatures: int = 1, folds: str = "loo", idCol: str = "battery_id",
                 numTrees: int = PRESETS["selection"]["numTrees"], maxDepth: int = PRESETS["selection"]["maxDepth"],
                 seed: int = PRESETS["selection"]["seed"], parallelism: int = 4, ledger: str = ""):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="_target", outputCol="selected", step=1.0, minFeatures=1,
                         folds="loo", idCol="battery_id", numTrees=200, maxDepth=15, seed=123, parallelism=4, ledger="")
        self._set(**self._input_kwargs)

    # --- helpers -----------------------------------------------------------------------
    def _forest(self, features_col: str):
        return forest(dict(numTrees=self.getOrDefault(self.numTrees), maxDepth=self.getOrDefault(self.maxDepth),
                           seed=self.getOrDefault(self.seed)),
                      featuresCol=features_col, labelCol=self.getLabelCol(), predictionCol="_rfe_pred")

    def _step(self, n: int) -> int:
        s = self.getOrDefault(self.step)
        return max(1, int(s * n)) if 0 < s < 1 else max(1, int(s))

    def _eliminate(self, ledger: Ledger, fold: int, train: DataFrame, test: DataFrame | None, n: int, n_select: int):
        """One elimination path; returns (sizes, scores, ranking, active)."""
        step = self._step(n)
        active = list(range(n))
        ranking = [1] * n
        sizes, scores = [], []
        est = self._forest("_rfe_x")

        def fit_score(feats: list[int]) -> tuple[float | None, list[int]]:
            sl = VectorSlicer(inputCol=self.getFeaturesCol(), outputCol="_rfe_x", indices=feats)
            model = est.fit(sl.transform(train))
            sc = None
            if test is not None:
                p = model.transform(sl.transform(test))
                e = F.col("_rfe_pred") - F.col(self.getLabelCol())
                sc = -float(p.agg(F.avg(e * e)).first()[0])
            imp = model.featureImportances.toArray()
            order = sorted(range(len(feats)), key=lambda j: (imp[j], j))
            drop = {feats[j] for j in order[: min(step, len(feats) - n_select)]}
            return sc, [a for a in feats if a not in drop]

        while len(active) > n_select or (test is not None and len(active) not in sizes):  # the last size is scored too
            now = list(active)
            sc, active = ledger.step(fold, len(now), lambda: fit_score(now))
            sizes.append(len(now))
            scores.append(sc)
            if len(now) > n_select:
                for i in set(range(n)) - set(active):
                    ranking[i] += 1
        return sizes, scores, ranking, active

    def _run_id(self, data: DataFrame) -> str:
        """What a ledger's steps depend on: the rows with their folds, and the settings."""
        rows = data.select(F.xxhash64("_rfe_fold", vector_to_array(self.getFeaturesCol()), self.getLabelCol()).alias("h"))
        rows = rows.agg(F.count("h"), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(1 << 30)))).first()
        settings = [self.getOrDefault(p) for p in (self.step, self.minFeatures, self.numTrees, self.maxDepth, self.seed)]
        return hashlib.sha256(repr((tuple(rows), settings)).encode()).hexdigest()[:16]

    def _fit(self, dataset: DataFrame) -> "RecursiveFeatureEliminationModel":
        feats = self.getFeaturesCol()
        n = int(len(dataset.select(feats).first()[0]))
        min_f = max(1, self.getOrDefault(self.minFeatures))
        folds = self.getOrDefault(self.folds)
        folds = folds if folds == "loo" else int(folds)
        data = with_folds(dataset, self.getOrDefault(self.idCol), folds, "_rfe_fold").persist()
        fold_ids = sorted(r[0] for r in data.select("_rfe_fold").distinct().collect())
        spark, path = dataset.sparkSession, self.getOrDefault(self.ledger)
        ledger = Ledger(spark, path or None, self._run_id(data) if path else "")

        def run(k):
            tr = data.where(F.col("_rfe_fold") != k)
            te = data.where(F.col("_rfe_fold") == k)
            sizes, scores, _, _ = self._eliminate(ledger, k, tr, te, n, min_f)
            return sizes, scores

        try:
            with ThreadPoolExecutor(max_workers=max(1, self.getOrDefault(self.parallelism))) as pool:
                paths = list(pool.map(inheritable_thread_target(spark)(run), fold_ids))
            sizes = paths[0][0]
            mean_scores = [sum(p[1][i] for p in paths) / len(paths) for i in range(len(sizes))]
            best = max(mean_scores)
            # smallest feature count among the best mean scores
            n_select = min(s for s, m in zip(sizes, mean_scores) if m == best)
            _, _, ranking, active = self._eliminate(Ledger(spark, path and f"{path}/to-{n_select}", ledger.run), ALL_ROWS, data, None, n, n_select)
        finally:
            data.unpersist()
        return RecursiveFeatureEliminationModel(
            featuresCol=feats, outputCol=self.getOutputCol(), selectedIndices=sorted(active), ranking=ranking,
            cvSizes=[int(s) for s in sizes], cvScores=[float(s) for s in mean_scores])


class RecursiveFeatureEliminationModel(Model, HasFeaturesCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    selectedIndices = Param(Params._dummy(), "selectedIndices", "kept feature positions", TypeConverters.toListInt)
    ranking = Param(Params._dummy(), "ranking", "rank per feature (1 = kept)", TypeConverters.toListInt)
    cvSizes = Param(Params._dummy(), "cvSizes", "feature counts scored", TypeConverters.toListInt)
    cvScores = Param(Params._dummy(), "cvScores", "mean CV score per count", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", outputCol: str = "selected", selectedIndices=None,
                 ranking=None, cvSizes=None, cvScores=None):
        super().__init__()
        self._setDefault(featuresCol="features", outputCol="selected")
        self._set(**self._input_kwargs)

    def getSelectedIndices(self) -> list[int]:
        return list(self.getOrDefault(self.selectedIndices))

    def getRanking(self) -> list[int]:
        return list(self.getOrDefault(self.ranking))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return VectorSlicer(inputCol=self.getFeaturesCol(), outputCol=self.getOutputCol(),
                            indices=self.getSelectedIndices()).transform(dataset)

    def ranking_table(self, spark: SparkSession, names) -> DataFrame:
        """``feature_idx, feature_name, rank, selected``."""
        rows = [(i, str(names[i]), int(r), int(r) == 1) for i, r in enumerate(self.getRanking())]
        schema = T.StructType([T.StructField("feature_idx", T.IntegerType()), T.StructField("feature_name", T.StringType()),
                               T.StructField("rank", T.IntegerType()), T.StructField("selected", T.BooleanType())])
        return spark.createDataFrame(rows, schema)

    def score_table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.getOrDefault(self.cvSizes), self.getOrDefault(self.cvScores)))
        return spark.createDataFrame(rows, "n_features int, mean_score double")
