"""Sources, sinks and scalar functions: S1-S9, P1-P14."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxeval import fixtures as fx
from voxeval.functions import scalars as S
from voxeval.sources import tables as IO
from voxeval.session import fresh_path
from voxeval.suite.base import clip, loss, query, sig


@query("s1_read_table", "uid:s y:d6", "SELECT doc_id::VARCHAR AS uid, quality AS y FROM labels")
def s1(spark, sf):
    """Labels written as CSV and read back with ids as text."""
    path = fresh_path(spark, "labels") + ".csv"
    lab = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("uid"), F.col("quality").alias("is_pathologic"))
    lab.write.option("header", True).csv(path)
    return IO.read_table(spark, path, IO.LABELS, "csv").withColumnRenamed("is_pathologic", "y")


@query("s2_file_inventory", "uid:s path:s", """SELECT uid, split_part(min(r || '|' || path), '|', 2) AS path FROM (
    SELECT split_part(name, '.', 1) AS uid, path, CASE WHEN name LIKE '%.html' THEN 0 WHEN name LIKE '%.htm' THEN 1 END AS r
    FROM (SELECT url || CASE WHEN page_id % 3 = 0 THEN '.htm' ELSE '.html' END AS path,
          split_part(url || CASE WHEN page_id % 3 = 0 THEN '.htm' ELSE '.html' END, '/', -1) AS name FROM pages)
    ) WHERE r IS NOT NULL GROUP BY uid""")
def s2(spark, sf):
    ext = F.when(F.col("page_id") % 3 == 0, ".htm").otherwise(".html")
    paths = fx.table(spark, sf, "pages").select(F.concat("url", ext).alias("path"))
    return IO.inventory_from_paths(paths, (".html", ".htm"))


@query("s3_missing_keys", "uid:s", """SELECT doc_id::VARCHAR AS uid FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def s3(spark, sf):
    key = F.col("doc_id").cast("string").alias("uid")
    return IO.missing_keys(fx.table(spark, sf, "documents").select(key), fx.table(spark, sf, "labels").select(key))


@query("s4_read_volumes", "uid:s z:i y:i x:i v:d6", "SELECT uid, z, y, x, (v::FLOAT)::DOUBLE AS v FROM stack16", ["stack16"])
def s4(spark, sf):
    """Volumes stored as planes and read back as long voxels."""
    path = fresh_path(spark, "volumes")
    IO.write_volumes(fx.stack16(spark, sf).withColumn("uid", F.col("uid").cast("string")), path, (8, 8))
    return IO.read_volumes(spark, path, 8)


@query("s4_sparse_round_trip", "uid:s z:i y:i x:i v:d6", """SELECT uid, z, y, x, CASE WHEN v > 15e-1 THEN (v::FLOAT)::DOUBLE ELSE 0e0 END AS v FROM stack16 s
    WHERE EXISTS (SELECT 1 FROM stack16 o WHERE o.uid = s.uid AND o.z = s.z AND o.v > 15e-1)""", ["stack16"])
def s4s(spark, sf):
    """Bright voxels only: every plane that has one comes back whole."""
    path = fresh_path(spark, "volumes")
    IO.write_volumes(fx.stack16(spark, sf).where("v > 1.5").withColumn("uid", F.col("uid").cast("string")), path, (8, 8))
    return IO.read_volumes(spark, path, 8)


def _configs(spark, sf):
    """One configuration per run, from the OOF rows themselves."""
    raw = fx.raw_oof(spark, sf)
    nets = raw.groupBy("run", "split", "k", "family").agg(
        F.array_sort(F.collect_set(F.col("seed").cast("int"))).alias("seeds"))
    members = F.array_sort(F.collect_list(F.struct(
        F.col("family").alias("name"), "seeds", F.lit(None).cast("array<string>").alias("files"), F.lit(None).cast("array<double>").alias("weights"))))
    cfg = nets.groupBy("run", "split", "k").agg(members.alias("nets"))
    return cfg.select("run", F.col("k").cast("int").alias("folds"), F.col("split").cast("int").alias("split_seed"), "nets")


@query("s5_run_config", "run:s split_seed:i family:s seed:i fold:i file:s weight:d6", """SELECT DISTINCT run, split AS split_seed, family, seed, fold, file,
    1e0 AS weight FROM raw_oof""", ["raw_oof"])
def s5(spark, sf):
    """Nested JSON configs written, read with their schema and exploded to checkpoints."""
    path = fresh_path(spark, "configs")
    _configs(spark, sf).write.partitionBy().json(path)
    return IO.checkpoints(spark.read.schema(IO.RUN_CONFIG).json(path))


@query("s6_read_runs", "run:s n:i mean_z:d6", "SELECT run, count(*) AS n, avg(z) AS mean_z FROM raw_oof WHERE run IN ('a', 'b') GROUP BY run", ["raw_oof"])
def s6(spark, sf):
    """Two of three runs out of one partitioned table."""
    path = fresh_path(spark, "runs")
    IO.write_oof(fx.raw_oof(spark, sf), path)
    return IO.read_runs(spark, path, ["a", "b"]).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z"))


@query("s7_write_oof", "run:s uid:s y:i fold:i cnn:d6 gbm:d6 lr:d6", "SELECT 'a' AS run, uid, y, fold, cnn, gbm, lr FROM wide_oof", ["wide_oof"])
def s7(spark, sf):
    path = fresh_path(spark, "oof")
    IO.write_oof(fx.wide_oof(spark, sf).select("run", "uid", "y", "fold", "cnn", "gbm", "lr"), path)
    return IO.read_runs(spark, path, ["a"])


@query("s8_submission", "pos:i uid:s is_pathologic:d6", f"""SELECT pos, uid, CASE WHEN ok = 1 THEN {sig("2e0 * x")} ELSE 55e-2 END AS is_pathologic
    FROM scans JOIN subjects USING (uid, pos)""", ["scans"])
def s8(spark, sf):
    """Failed scans are absent from the scores and get the prior."""
    good = fx.scans(spark, sf).where("ok = 1").select("uid")
    scored = fx.subjects(spark, sf).join(good, "uid").select("uid", S.sigmoid(F.col("x") * 2.0).alias("p"))
    return IO.submission(fx.subjects(spark, sf).select("uid", "pos"), scored, 0.55)


@query("s9_write_params", "name:s value:d6", """SELECT 'mean' AS name, avg(x) AS value FROM subjects UNION ALL
    SELECT 'prior', avg(y) FROM subjects UNION ALL SELECT 'sd', stddev_pop(x) FROM subjects""", ["subjects"])
def s9(spark, sf):
    """Fitted parameters written as JSON and read back."""
    got = fx.subjects(spark, sf).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.avg("y").alias("p")).first()
    path = fresh_path(spark, "params")
    IO.write_params(spark, {"coef": [got["m"], got["s"]], "prior": got["p"]}, path)
    row = spark.read.schema(T.StructType([
        T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("prior", T.DoubleType())])).json(path)
    cells = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (
        ("mean", F.col("coef")[0]), ("sd", F.col("coef")[1]), ("prior", F.col("prior")))])
    return row.select(F.explode(cells).alias("c")).select("c.name", "c.value")


@query("p1_clean_value", "uid:i t:i z:i y:i x:i v:d6", """SELECT uid, t, z, y, x, CASE WHEN isnan(v) OR isinf(v) THEN 0e0 ELSE greatest(v, 0e0) END AS v
    FROM frames""", ["frames"])
def p1(spark, sf):
    return fx.frames(spark, sf).withColumn("v", S.clean_value("v"))


@query("p2_sane_spacing", "uid:s s:d6", """SELECT uid, CASE WHEN s > 3e-1 AND s < 20e0 AND NOT isnan(s) THEN s ELSE 2e0 END AS s FROM (
    SELECT uid, CASE WHEN pos % 11 = 0 THEN 'NaN'::DOUBLE WHEN pos % 7 = 0 THEN zoom * 10e0 WHEN pos % 5 = 0 THEN zoom / 10e0 ELSE zoom END AS s FROM subjects)""",
       ["subjects"])
def p2(spark, sf):
    pos, z = F.col("pos"), F.col("zoom")
    s = F.when(pos % 11 == 0, F.lit(float("nan"))).when(pos % 7 == 0, z * 10.0).when(pos % 5 == 0, z / 10.0).otherwise(z)
    return fx.subjects(spark, sf).select("uid", S.sane_spacing(s).alias("s"))


@query("p3_group_key", "uid:s key:s", """SELECT uid, CASE WHEN ok = 1 THEN printf('%dx%dx%d_%.2f', shape_x, shape_y, shape_z, zoom_x) ELSE 'fail' END AS key
    FROM scans""", ["scans"])
def p3(spark, sf):
    return fx.scans(spark, sf).select("uid", S.group_key("ok", "shape_x", "shape_y", "shape_z", "zoom_x").alias("key"))


@query("p4_family_key", "uid:s fam:s", """SELECT uid, coalesce((round_even(z * 10e0, 0) / 10e0)::VARCHAR, 'na') AS fam FROM (
    SELECT uid, CASE WHEN pos % 13 <> 0 THEN zoom + 5e-2 END AS z FROM subjects)""", ["subjects"])
def p4(spark, sf):
    z = F.when(F.col("pos") % 13 != 0, F.col("zoom") + 0.05)
    return fx.subjects(spark, sf).select("uid", S.family_key(z).alias("fam"))


@query("p5_link_functions", "uid:s p:d6 z:d6", f"""SELECT uid, p, ln(q / (1e0 - q)) AS z FROM (SELECT uid, p, {clip("p", "1e-6", "(1e0 - 1e-6)")} AS q
    FROM (SELECT uid, {sig("8e0 * x")} AS p FROM subjects))""", ["subjects"])
def p5(spark, sf):
    return fx.subjects(spark, sf).select("uid", S.sigmoid(F.col("x") * 8.0).alias("p")).withColumn("z", S.logit("p"))


@query("p6_row_logloss", "uid:s l:d6", f"SELECT uid, {loss('y', sig('2e0 * x'))} AS l FROM subjects", ["subjects"])
def p6(spark, sf):
    return fx.subjects(spark, sf).select("uid", S.row_logloss("y", S.sigmoid(F.col("x") * 2.0)).alias("l"))


@query("p7_standardize_clip", "uid:s f_len:d6", f"SELECT uid, {clip('(f_len - 6e0) / 5e-1', '-6e0', '6e0')} AS f_len FROM features", ["features"])
def p7(spark, sf):
    return fx.features(spark, sf).select("uid", S.standardize_clip("f_len", F.lit(6.0), F.lit(0.5)).alias("f_len"))


PARAMS = {"cols": ["f_len", "f_words"], "mu": [6.0, 4.0], "sd": [1.5, 1.25], "coef": [0.75, -0.5], "b": 0.25,
          "adj": [[0.5, 0.25], [0.125, -0.25], [0.0625, 0.03125]]}


@query("p8_linear_score", "uid:s z:d6", f"""SELECT uid, 25e-2 + 75e-2 * {clip("(f_len - (5e-1 + 125e-3 * m + 625e-4 * m * m) - 6e0) / 15e-1", "-6e0", "6e0")}
    - 5e-1 * {clip("(f_words - (25e-2 - 25e-2 * m + 3125e-5 * m * m) - 4e0) / 125e-2", "-6e0", "6e0")} AS z
    FROM (SELECT *, CASE WHEN fold = 0 THEN 24e-1 ELSE zoom END AS m FROM features)""", ["features"])
def p8(spark, sf):
    rows = fx.features(spark, sf).withColumn("zoom", F.when(F.col("fold") != 0, F.col("zoom")))
    return rows.select("uid", S.linear_score(PARAMS, "zoom").alias("z"))


@query("p9_fill_features", "uid:s f_len:d6 f_spare:d6 f_absent:d6", """SELECT uid, f_len, CASE WHEN isnan(f_spare) THEN 0e0 ELSE f_spare END AS f_spare,
    0e0 AS f_absent FROM features""", ["features"])
def p9(spark, sf):
    return S.fill_features(fx.features(spark, sf), ["f_len", "f_spare", "f_absent"])


@query("p10_feature_columns", "uid:s f_len:d6 f_ratio:d6", "SELECT uid, f_len, f_ratio FROM features", ["features"])
def p10(spark, sf):
    rows = fx.features(spark, sf)
    names = S.feature_columns(rows, contains=("len", "ratio"))
    return rows.select("uid", *names)


@query("p11_replace_columns", "uid:s f_len:d6 f_words:d6 zoom:d6", "SELECT uid, f_len * 2e0 AS f_len, f_words, zoom FROM features", ["features"])
def p11(spark, sf):
    rows = fx.features(spark, sf)
    return S.replace_columns(rows.select("uid", "f_len", "f_words", "zoom"), rows.select("uid", (F.col("f_len") * 2.0).alias("f_len")))


@query("p12_finalize_probability", "uid:s p:d6", f"""SELECT uid, CASE WHEN ok = 1 THEN {clip(sig("6e0 * x / 11e-1"), "1e-3", "(1e0 - 1e-3)")} ELSE 55e-2 END AS p
    FROM scans JOIN subjects USING (uid)""", ["scans"])
def p12(spark, sf):
    rows = fx.scans(spark, sf).select("uid", "ok").join(fx.subjects(spark, sf).select("uid", "x"), "uid")
    return rows.select("uid", S.finalize_probability(F.col("x") * 6.0, "ok", eps=0.0, prior=0.55, temp=1.1).alias("p"))


@query("p13_noisy_or", "uid:s z:d6", f"""SELECT uid, ln(1e0 - exp(l)) - l AS z FROM (SELECT uid,
    {clip("-ln(1e0 + exp(x)) - ln(1e0 + exp(-5e-1 * x))", "-30e0", "-1e-6")} AS l FROM subjects)""", ["subjects"])
def p13(spark, sf):
    return fx.subjects(spark, sf).select("uid", S.noisy_or_logit(F.col("x"), F.col("x") * -0.5).alias("z"))


@query("p14_center_gain", "uid:i i:i centred:d6 gained:d6 dimmed:d6", """SELECT vec_id AS uid, generate_subscripts(embedding, 1) - 1 AS i,
    (unnest(embedding)::DOUBLE - 1e0) / 2e0 AS centred, 1e0 + (unnest(embedding)::DOUBLE - 1e0) * 108e-2 AS gained,
    unnest(embedding)::DOUBLE * 7e-1 AS dimmed FROM embeddings""")
def p14(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    z = F.arrays_zip(S.center_scale("embedding").alias("c"), S.gain("embedding", 1.08).alias("g"), S.scale("embedding", 0.7).alias("d"))
    rows = e.select(F.col("vec_id").alias("uid"), F.posexplode(z).alias("i", "s"))
    return rows.select("uid", "i", F.col("s.c").alias("centred"), F.col("s.g").alias("gained"), F.col("s.d").alias("dimmed"))


