"""Tables in and out: typed reads, file inventory, run configs, OOF, submission and parameters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = T.StructType([T.StructField("uid", T.StringType()), T.StructField("is_pathologic", T.DoubleType())])
VOLUMES = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("z", T.IntegerType()),
        T.StructField("plane", T.ArrayType(T.FloatType())),
    ]
)
RUN_CONFIG = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("folds", T.IntegerType()),
        T.StructField("split_seed", T.IntegerType()),
        T.StructField(
            "nets",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("seeds", T.ArrayType(T.IntegerType())),
                        T.StructField("files", T.ArrayType(T.StringType())),
                        T.StructField("weights", T.ArrayType(T.DoubleType())),
                    ]
                )
            ),
        ),
        T.StructField("groups", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("group_weights", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """CSV or parquet with a declared schema; ids stay text."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def inventory_from_paths(paths: DataFrame, extensions: Sequence[str], path: str = "path", keep: Sequence[str] = ()) -> DataFrame:
    """One file per uid out of a table of paths: uid is the name up to the first dot, earlier extensions win."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    rank = F.lit(None).cast("int")
    for i, ext in reversed(list(enumerate(extensions))):
        rank = F.when(name.endswith(ext), F.lit(i)).otherwise(rank)
    rows = paths.select(F.substring_index(name, ".", 1).alias("uid"), F.col(path).alias("path"), rank.alias("_rank"), *keep)
    rows = rows.where(F.col("_rank").isNotNull())
    # min_by over (rank, path): partial aggregation keeps one candidate per uid and task
    order = F.struct("_rank", "path")
    best = [F.min_by(c, order).alias(c) for c in ("path", *keep)]
    return rows.groupBy("uid").agg(*best)


def file_inventory(spark: SparkSession, root: str, extensions: Sequence[str] = (".nii.gz", ".nii")) -> DataFrame:
    """Recursive listing without reading contents."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length")
    )
    return inventory_from_paths(files, extensions, keep=("length",))


def missing_keys(want: DataFrame, have: DataFrame, key: str = "uid") -> DataFrame:
    """Wanted keys that are not there (S3)."""
    return want.select(key).join(have.select(key), key, "left_anti")


def write_volumes(voxels: DataFrame, path: str, shape: tuple[int, int]) -> None:
    """Long voxels to one row per (uid, z) with the whole plane of ``shape`` (height, width) in row-major order.

    Places without a voxel are 0; a place that repeats or lies outside the plane fails.
    """
    h, w = shape
    at = F.col("y") * w + F.col("x")
    inside = F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1)
    at = F.when(inside, at).otherwise(F.raise_error(F.lit(f"a voxel outside the {h} x {w} plane")).cast("int"))
    planes = voxels.groupBy("uid", "z").agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int").alias("k"), F.col("v").cast("float").alias("v")))).alias("p"))
    plane = F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.coalesce(F.try_element_at("p", i), F.lit(0.0).cast("float")))
    planes.select("uid", "z", plane.alias("plane")).write.mode("overwrite").parquet(path)


def planes_to_voxels(planes: DataFrame, width: int, plane: str = "plane") -> DataFrame:
    """Long voxels of plane rows."""
    keep = [c for c in planes.columns if c != plane]
    long = planes.select(*keep, F.posexplode(plane).alias("_p", "_v"))
    w = F.lit(width)
    return long.select(
        *keep,
        F.floor(F.col("_p") / w).cast("int").alias("y"),
        (F.col("_p") % w).cast("int").alias("x"),
        F.col("_v").cast("double").alias("v"),
    )


def read_volumes(spark: SparkSession, path: str, width: int) -> DataFrame:
    return planes_to_voxels(spark.read.schema(VOLUMES).parquet(path), width)


def read_run_config(spark: SparkSession, path: str) -> DataFrame:
    """Nested run configuration, one JSON object per file."""
    return spark.read.schema(RUN_CONFIG).option("multiLine", "true").json(path)


def checkpoints(configs: DataFrame) -> DataFrame:
    """Configs to checkpoint rows: nets x seeds x folds with file name and weight."""
    nets = configs.select("run", "folds", "split_seed", F.explode("nets").alias("n"))
    seeds = nets.select("run", "folds", "split_seed", "n", F.posexplode("n.seeds").alias("si", "seed"))
    rows = seeds.select("*", F.explode(F.sequence(F.lit(0), F.col("folds") - 1)).alias("fold"))
    i = F.col("si") * F.col("folds") + F.col("fold")
    default = F.format_string("%s_s%d_f%d", F.col("n.name"), F.col("seed"), F.col("fold"))
    return rows.select(
        "run", "split_seed", F.col("n.name").alias("family"), "seed", "fold",
        F.coalesce(F.get("n.files", i), default).alias("file"),
        F.coalesce(F.get("n.weights", i), F.lit(1.0)).alias("weight"),
    )


def group_table(configs: DataFrame) -> DataFrame:
    """Configs to (run, grp, family, weight); a missing weight is 1."""
    g = configs.select("run", "group_weights", F.explode("groups").alias("grp", "members"))
    g = g.select("run", "grp", "group_weights", F.explode("members").alias("family"))
    w = F.element_at(F.element_at("group_weights", F.col("grp")), F.col("family"))
    return g.select("run", "grp", "family", F.coalesce(w, F.lit(1.0)).alias("weight"))


def read_runs(spark: SparkSession, root: str, runs: Sequence[str] | None = None) -> DataFrame:
    """OOF tables of several runs in one scan; ``run`` is a partition column, so the choice prunes folders."""
    df = spark.read.parquet(root)
    return df if runs is None else df.where(F.col("run").isin(list(runs)))


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Stack tables by column name under their run name."""
    parts = [df.withColumn("run", F.lit(name)) for name, df in runs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Files that a task writes side by side.
OPEN_RUNS = 16


def write_oof(oof: DataFrame, root: str) -> None:
    """OOF rows below one folder per run.

    A task keeps one file open per run instead of sorting its rows by run first, which spills all of them; with more runs than
    ``OPEN_RUNS`` in a task Spark sorts the rest.
    """
    conf, key = oof.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key, None)
    conf.set(key, str(OPEN_RUNS))
    try:
        oof.write.mode("overwrite").partitionBy("run").parquet(root)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def submission(fmt: DataFrame, scored: DataFrame, prior: float) -> DataFrame:
    """One row per requested uid in the requested order; unscored rows get the prior."""
    p = scored.select("uid", F.col("p"))
    rows = fmt.select("uid", "pos").join(p, "uid", "left")
    return rows.select("pos", "uid", F.coalesce("p", F.lit(float(prior))).alias("is_pathologic")).orderBy("pos")


def write_submission(sub: DataFrame, path: str) -> None:
    """CSV parts in request order: range partitioned by position, never through one task."""
    ordered = sub.repartitionByRange("pos").sortWithinPartitions("pos")
    ordered.select("uid", "is_pathologic").write.mode("overwrite").option("header", True).csv(path)


def params_frame(spark: SparkSession, params: dict) -> DataFrame:
    """Fitted parameters as a one-row struct table."""
    def field(k, v):
        if isinstance(v, (list, tuple)):
            inner = T.StringType() if v and isinstance(v[0], str) else T.DoubleType()
            if v and isinstance(v[0], (list, tuple)):
                inner = T.ArrayType(T.DoubleType())
            return T.StructField(k, T.ArrayType(inner))
        return T.StructField(k, T.StringType() if isinstance(v, str) else T.DoubleType())

    def value(v):
        if isinstance(v, (list, tuple)):
            return [value(x) for x in v]
        return v if isinstance(v, str) else float(v)

    schema = T.StructType([field(k, v) for k, v in params.items()])
    return spark.createDataFrame([tuple(value(v) for v in params.values())], schema)


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    params_frame(spark, params).write.mode("overwrite").json(path)


def read_params(spark: SparkSession, path: str) -> dict:
    return spark.read.json(path).first().asDict(recursive=True)
