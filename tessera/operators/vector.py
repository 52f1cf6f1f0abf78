"""Vector search: exact k nearest neighbours and an inverted-file index with flat lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("l2", "cosine")


def distance(metric: str, column: str, query: list[float]) -> Column:
    """l2: Euclidean distance; cosine: one minus the cosine."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    q = F.array(*[F.lit(float(v)) for v in query])
    v = F.col(column).cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    if metric == "l2":
        return F.sqrt(total(F.zip_with(v, q, lambda a, b: (a - b) * (a - b))))
    dot, size = total(F.zip_with(v, q, lambda a, b: a * b)), F.sqrt(total(F.transform(v, lambda a: a * a)))
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    return 1 - F.try_divide(dot, size * F.lit(norm))


def _check(df: DataFrame, column: str, output: list[str], k: int) -> None:
    if column not in df.columns:
        raise ValueError(f"unknown vector column {column}")
    if not output:
        raise ValueError("output_columns must not be empty")
    if missing := [c for c in output if c not in df.columns]:
        raise ValueError(f"unknown output columns {missing}")
    if k < 1:
        raise ValueError("k must be at least 1")


def knn(df: DataFrame, column: str, query: list[float], k: int = 10, metric: str = "l2", output_columns: list[str] | None = None) -> DataFrame:
    """At most k rows, nearest first, with a trailing ``distance``; one local top-k a partition."""
    output = df.columns if output_columns is None else output_columns
    _check(df, column, output, k)
    d = distance(metric, column, query)
    n = F.size(column)
    checked = F.when(F.col(column).isNull(), F.lit(None).cast("double")).when(n != len(query), F.raise_error(F.lit(f"the query has {len(query)} dimensions")).cast("double")).otherwise(d)
    return df.select(*output, checked.alias("distance")).where("distance is not null").orderBy("distance", *[c for c in output if c != column]).limit(k)


class StaleIndexError(RuntimeError):
    """The table has changed since the index was built, or the index is dropped."""


def fingerprint(df: DataFrame) -> tuple:
    """What tells one state of a file-based table from another: its files, their lengths and times."""
    spark = df.sparkSession
    found = []
    for f in sorted(df.inputFiles()):
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        found.append((f, status.getLen(), status.getModificationTime()))
    return tuple(found)


@dataclass
class IvfIndex:
    """Centroids (at most ``n_lists``) and the rows with their list; stale once the source's files change."""

    rows: DataFrame
    centroids: list[list[float]]
    column: str
    metric: str
    source: DataFrame | None = None
    seen: tuple = ()
    dropped: bool = False

    def check(self) -> None:
        if self.dropped:
            raise StaleIndexError("the index is dropped")
        if self.source is not None:
            try:
                now = fingerprint(self.source)
            except Exception as e:  # a file that is gone
                raise StaleIndexError("the indexed table is gone") from e
            if now != self.seen:
                raise StaleIndexError("the table has changed since the index was built")

    def drop(self) -> None:
        self.dropped = True

    def lists_for(self, query: list[float], n_probes: int) -> list[int]:
        """The nearest lists; for the cosine centroids and the query are normalised, as the rows were."""
        q = _unit(query) if self.metric == "cosine" else [float(v) for v in query]
        far = lambda c: sum((a - b) ** 2 for a, b in zip(_unit(c) if self.metric == "cosine" else c, q, strict=True))
        return sorted(range(len(self.centroids)), key=lambda i: (far(self.centroids[i]), i))[: max(1, n_probes)]

    def search(self, query: list[float], k: int = 10, n_probes: int = 8, output_columns: list[str] | None = None) -> DataFrame:
        self.check()
        if self.centroids and len(query) != len(self.centroids[0]):
            raise ValueError(f"the query has {len(query)} dimensions, the index {len(self.centroids[0])}")
        own = output_columns or [c for c in self.rows.columns if c != "_list"]
        lists = self.lists_for(query, n_probes)
        return knn(self.rows.where(F.col("_list").isin(lists)), self.column, query, k, self.metric, own)


def _unit(v: list[float]) -> list[float]:
    norm = sum(float(x) ** 2 for x in v) ** 0.5
    return [float(x) / norm for x in v] if norm else [float(x) for x in v]


def create_index(df: DataFrame, column: str, metric: str = "l2", n_lists: int = 16, seed: int = 7, sample: int = 20_000) -> IvfIndex:
    """K-means on at most ``sample`` rows, then every row is assigned on the JVM to its nearest centroid.

    Rows without a vector are in no list. For the cosine, vectors are normalised before they are clustered."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    _check(df, column, [column], 1)
    usable = df.where(F.col(column).isNotNull() & (F.size(column) > 0))
    n = usable.count()
    if not n:
        return IvfIndex(usable.withColumn("_list", F.lit(0)), [], column, metric, df, fingerprint(df))
    v = F.col(column).cast("array<double>")
    if metric == "cosine":
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        v = F.transform(v, lambda x: F.when(norm > 0, F.try_divide(x, norm)).otherwise(x))
    featured = usable.withColumn("_features", array_to_vector(v))
    training = featured.select("_features")
    if n > sample:
        training = training.sample(sample / n, seed)
    model = KMeans(k=min(n_lists, max(2, n)), seed=seed, maxIter=10, featuresCol="_features", predictionCol="_list").fit(training)
    centroids = [c.tolist() for c in model.clusterCenters()]
    return IvfIndex(model.transform(featured).drop("_features"), centroids, column, metric, df, fingerprint(df))
