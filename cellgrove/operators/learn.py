"""MLlib baselines and embedding analysis."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def assemble(cells: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(cells)


def balanced(rows: DataFrame) -> DataFrame:
    """Adds weight: N / (3 n) of the row's class."""
    n = rows.groupBy("y").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return rows.join(F.broadcast(n.crossJoin(total)), "y").withColumn("weight", F.col("total") / (3 * F.col("n"))).drop("n", "total")  # three rows


def random_forest(rows: DataFrame, trees: int = 100, depth: int = 20, seed: int = 42):
    """Fits features against y (1..3) with balanced weights."""
    data = balanced(rows).withColumn("label", (F.col("y") - 1).cast("double"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight").fit(data)


def perceptron(rows: DataFrame, width: int, hidden=(64, 32), rounds: int = 50, seed: int = 42):
    data = rows.withColumn("label", (F.col("y") - 1).cast("double"))
    return MultilayerPerceptronClassifier(layers=[width, *hidden, 3], maxIter=rounds, seed=seed, blockSize=256).fit(data)


def predict(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("pred", (F.col("prediction") + 1).cast("int")).drop("prediction", "rawPrediction", "probability")


def save_model(model, path: str, about: dict[str, str]) -> None:
    """The model in path/model, and a manifest beside it: its kind, its parameters and what about says (profile, columns ..)."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    said = {"kind": type(model).__name__, "parameters": str({p.name: v for p, v in sorted(model.extractParamMap().items(), key=lambda x: x[0].name)})} | about
    spark.createDataFrame([(k, str(v)) for k, v in said.items()], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_model(path: str):
    """The model that save_model wrote, and its manifest as a dictionary."""
    from pyspark.ml import classification, feature

    said = {r["name"]: r["value"] for r in SparkSession.active().read.json(f"{path}/manifest").collect()}  # a row per entry
    kind = getattr(classification, said["kind"], None) or getattr(feature, said["kind"])
    return kind.load(f"{path}/model"), said


def component_correlations(transformed: DataFrame, columns: list[str], k: int) -> DataFrame:
    """component, feature and r for the first k components against feature columns, one pass of sums."""
    at = component_array(transformed).select(*[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(k)], *[F.col(c).cast("double").alias(c) for c in columns])
    one = at.agg(*[F.corr(f"pc{i}", c).alias(f"{i}/{c}") for i in range(1, k + 1) for c in columns])
    rows = F.array(*[F.struct(F.lit(i).alias("component"), F.lit(c).alias("feature"), F.col(f"{i}/{c}").alias("r")) for i in range(1, k + 1) for c in columns])
    return one.select(F.inline(rows))


def importance(model, columns: list[str]) -> DataFrame:
    spark = SparkSession.active()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


def principal_components(vectors: DataFrame, column: str, k: int):
    """Standardised vectors, the PCA model and the explained shares with their running sum."""
    data = vectors.withColumn("raw", array_to_vector(F.col(column).cast("array<double>")))
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(data).transform(data)
    model = PCA(k=k, inputCol="scaled", outputCol="pc").fit(scaled)
    shares = vectors.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())], "component int, share double")  # k rows
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return model.transform(scaled), model, shares.withColumn("cumulative", F.sum("share").over(w))


def dimensions_for(shares: DataFrame, targets=(0.90, 0.95, 0.99)) -> DataFrame:
    """The first component at which the cumulative share reaches each target."""
    return shares.agg(*[F.min(F.when(F.col("cumulative") >= t, F.col("component"))).alias(f"d{int(100 * t)}") for t in targets])


def component_array(transformed: DataFrame) -> DataFrame:
    return transformed.withColumn("pc", vector_to_array("pc"))
