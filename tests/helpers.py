from pyspark.sql import functions as F


def values(spark, expression, rows, schema):
    """The expression's value for each row, in order."""
    data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, f"i int, {schema}")
    return [r["o"] for r in df.select("i", expression.alias("o")).orderBy("i").collect()]


def tracks(spark, rows, extra="mp3_size string"):
    """Tracks of (path, artist, song, *extra), in that order."""
    data = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, f"ord long, path string, artist string, song string{', ' + extra if extra else ''}")
    return df.withColumn("file_types", F.array(F.lit("zip")))


def names(df):
    return [(r["artist"], r["song"]) for r in df.orderBy("ord").collect()]
