"""What the operators of this subpackage share: shipping the code, stored intermediate tables,
distributed ranking, connected components and vectorised hashing of words."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Whole words as every word-based operator here takes them (ASCII white space separates).
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the executors run."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "tessera_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, f"{package.name}/{path.relative_to(package)}")
    sc.addPyFile(target)
    sc._tessera_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Only a local master, whose executors are this machine, gets a
    temporary folder where that is unset; on a cluster it is an error, as executors do not share their disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_tessera_dir", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext._tessera_dir = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_SCOPES: list[dict[int, tuple[DataFrame, str]]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor
    costs no recomputation. Tables stay until ``tidy`` removes them."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _SCOPES:
        _SCOPES[-1][id(out)] = (out, path)
    return out


@contextmanager
def tidy(spark: SparkSession):
    """Within it, ``keep`` marks stored tables that outlive it (those a result still reads); the others are
    removed at its end. Without a mark from an outer ``tidy`` they stay until the shared folder is cleared."""
    scope: dict[int, tuple[DataFrame, str]] = {}
    kept: dict[int, tuple[DataFrame, str]] = {}

    def keep(df: DataFrame) -> DataFrame:
        if id(df) in scope:
            kept[id(df)] = scope[id(df)]
        return df

    _SCOPES.append(scope)
    try:
        yield keep
    finally:
        _SCOPES.remove(scope)
        for i, (_, path) in scope.items():
            if i not in kept:
                remove(spark, path)
        if _SCOPES:
            _SCOPES[-1].update(kept)


def stored_facts(df: DataFrame, name: str, count: str) -> tuple[DataFrame, int, int]:
    """``stored``, with the largest and the sum of its column ``count``, seen while it is written."""
    seen = Observation()
    out = stored(df.observe(seen, F.max(count).alias("most"), F.sum(count).alias("total")), name)
    found = seen.get
    return out, int(found["most"] or 0), int(found["total"] or 0)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget_parses(spark: SparkSession) -> None:
    """Empty the SQL parser's table of lookahead states, which is never emptied else and holds tens of MB of the driver's
    heap after expressions of thousands of characters. Only the speed of the next parses changes."""
    spark._jvm.org.apache.spark.sql.catalyst.parser.SqlBaseParser(None).getInterpreter().clearDFA()


def free_name(columns: list[str], name: str) -> str:
    """``name``, or with the smallest number that makes it one no column has (letter case apart)."""
    taken = {c.lower() for c in columns}
    found, i = name, 0
    while found.lower() in taken:
        i += 1
        found = f"{name}_{i}"
    return found


def nested(docs: DataFrame, used: list[str]) -> DataFrame:
    """The columns ``used`` and all others in one struct ``row_``, so that no name can clash with ours."""
    others = [c for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("row_"))


def unnested(columns: list[str], used: list[str]) -> list[Column]:
    """The columns that ``nested`` was made of, in their order."""
    others = [c for c in columns if c not in used]
    return [F.col(c) if c in used else F.col("row_")[f"c{others.index(c)}"].alias(c) for c in columns]


HOT_SHARE, HOT_LEAST = 1000, 256


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, most: int, how: str = "inner") -> DataFrame:
    """``rows`` with the ``facts`` of their ``key`` (unique there); ``count`` bounds how many rows have it, ``most`` and
    ``total`` are its largest and its sum.

    Keys with over a ``HOT_SHARE``th of all rows are at most HOT_SHARE; their facts are broadcast and
    their rows stay where they are, so no key's rows ever meet in one task."""
    limit = max(total // HOT_SHARE, HOT_LEAST)
    if most <= limit:
        return rows.join(facts, key, how)
    hot = F.broadcast(facts.where(F.col(count) > limit))
    cold = rows.join(F.broadcast(facts.where(F.col(count) > limit).select(key)), key, "left_anti").join(facts, key, how)
    return rows.join(hot, key).unionByName(cold)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_for(rows: int, per_bucket: int = 200_000) -> int:
    """How many hash buckets keep a bucket of one group near ``per_bucket`` rows if one group has all rows."""
    return max(1, -(-rows // per_bucket))


def ranked(df: DataFrame, group: list[str], order: list[Column], salt: Column, buckets: int, rank: str = "rank") -> DataFrame:
    """0-based gapless rank of each row within ``group``, without putting a group into one task.

    A group is dealt to ``buckets`` by ``salt``; ranks run bucket after bucket, inside a bucket in
    the given order. Only the counts of (group, bucket) are summed up over a group."""
    df = df.withColumn("_b", F.pmod(salt, F.lit(buckets)).cast("int"))
    keys = [*group, "_b"]
    within = Window.partitionBy(*keys).orderBy(*order)
    if buckets == 1:
        return df.withColumn(rank, F.row_number().over(within).cast("long") - 1).drop("_b")
    ahead = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    offsets = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_off")
    numbered = df.withColumn("_r", F.row_number().over(within).cast("long") - 1)
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = numbered.join(offsets, match)
    return joined.withColumn(rank, F.col("_off") + F.col("_r")).drop("_b", "_r", "_off", *[f"_k{i}" for i in range(len(keys))])


def components(edges: DataFrame, name: str = "components", most_rounds: int = 40) -> DataFrame:
    """(id, component) for every node of ``edges`` (u, v): component is the smallest id reachable.

    Alternating large-star and small-star contractions; every round's links are a stored table and
    nothing but counts reaches the driver. A root of many links is no hot key (``join_facts``)."""
    spark = edges.sparkSession
    with tidy(spark) as keep:
        links = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        for _ in range(most_rounds):
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("c"), F.count_if(F.col("v") < F.col("u")).alias("o"))
            seen = Observation()
            unsettled = (F.col("o") > 1) | ((F.col("o") > 0) & (F.col("c") > F.col("o")))
            low = stored(low.observe(seen, F.sum("c").alias("total"), F.max("c").alias("most"), F.max("o").alias("most_below"), F.bool_or(unsettled).alias("unsettled")), name)
            found = seen.get
            if not found["unsettled"]:
                break  # every node points to one root: stars
            large = join_facts(both, low.select("u", "m", "c"), "u", "c", found["total"], found["most"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            large = stored(large.distinct(), name)
            # a node has at most as many links here as it had to smaller ones
            least = large.groupBy("u").agg(F.min("v").alias("m")).join(low.select("u", "o"), "u")
            small = join_facts(large, least, "u", "o", found["total"], found["most_below"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            links = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), name)
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
        keep(links)
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


# vectorised word hashing

_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P, _PINV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: np.uint64, n: int, key: str) -> np.ndarray:
    if key not in _POW or len(_POW[key]) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0] = 1
        out[1:] = base
        _POW[key] = np.cumprod(out)
    return _POW[key][:n]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of one text (A-Z lower-cased), in order."""
    raw = np.frombuffer(data.translate(_LOWER), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    if not len(edge):
        return np.empty(0, np.uint64)
    start, end = edge[::2], edge[1::2]
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_P, n, "p"), out=total[1:])
    poly = (total[end] - total[start]) * _powers(_PINV, n + 1, "q")[start]
    return mix(poly + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; fewer words: the whole sequence as one."""
    w = word_hashes(data)
    n = len(w)
    if not n:
        return w
    k = min(k, n)
    h = w[: n - k + 1].copy()
    for i in range(1, k):
        h = h * np.uint64(0x9FB21C651E98DF25) + w[i : n - k + 1 + i]
        h ^= h >> np.uint64(29)
    return np.unique(mix(h + np.uint64(k)))
