"""Small documents with every odd case, shared by the tests of the operators."""

from pyspark.sql import types as T

#: Columns whose names the operators use themselves.
CLASHES = "size target node keys copies score _file _row sha digest ids decoded lang_pred hits doc title kept value part spans x y".split()
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
     T.StructField("n_chars", T.LongType())]
)
WIDE = T.StructType([*SCHEMA.fields, *[T.StructField(c, T.StringType()) for c in CLASHES]])


def passage(seed: int, n: int) -> str:
    """n words, mostly different ones."""
    return " ".join(f"w{(seed * 7919 + i * 104729) % 9973}{'.' if i % 11 == 10 else ''}" for i in range(n))


def odd_rows():
    long = passage(5, 30_000)
    texts = [
        (1, passage(1, 120)), (2, passage(1, 120)), (3, passage(1, 120).upper()), (4, passage(1, 119) + " changed"), (5, None), (6, ""), (7, " \t\n"),
        (8, "one two"), (9, "One two"), (None, passage(2, 80)), (None, passage(2, 80)), (12, long), (13, long + " tail"), (14, "x" * 200_000), (15, passage(3, 60)),
        (15, passage(3, 60)), (16, "Ünïcödé ß çà 日本語 🙂 ñandú"), (17, "12345 !!! ..."),
    ]
    sources = ["a", "a", "a", "b", None, "b", "a", "a", "c", "a", None, "a", "b", "a", "a", "a", "c", "c"]
    langs = ["en", None, "en", "de", None, "fr", "en", "en", "de", "en", "en", "fr", "de", "en", "en", "en", "es", None]
    return [(i, t, lang, s, None if t is None else len(t)) for (i, t), s, lang in zip(texts, sources, langs)]


def odd(spark, wide=False):
    if not wide:
        return spark.createDataFrame(odd_rows(), SCHEMA)
    return spark.createDataFrame([(*r, *["?"] * len(CLASHES)) for r in odd_rows()], WIDE)


def empty(spark, wide=False):
    return spark.createDataFrame([], WIDE if wide else SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def insults_table(spark):
    """Documents of every kind, and labels: toxic ones below 1000, near copies from 3000 on."""
    items = [(i, f"{passage(i, 40)} you total idiot {passage(i + 50, 20)}") for i in range(60)]
    items += [(2000 + i, passage(500 + i, 50)) for i in range(200)] + [(3000 + i, passage(9, 90) + f" end{i}") for i in range(3)]
    items += [(4000, None), (4001, ""), (4002, passage(505, 50).upper()), (None, passage(506, 50))]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None) for i, t in items], SCHEMA)
    labels = [(i, int(i < 1000)) for i, _ in items if i is not None]
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")
