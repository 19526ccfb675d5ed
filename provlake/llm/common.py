"""What the corpus operators share: reading, written intermediate tables, held-out rows, regular-expression spans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A word is a run of Unicode letters with their marks, in Python (the `regex` module) and in Spark's functions alike.
WORD = r"\p{L}[\p{L}\p{M}]*"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own is made only on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Folders of this process's tables.
_PATHS: list[str] = []


def clear_tables(spark: SparkSession) -> None:
    """Delete the tables that materialize() has written in this process. Results that read them must have been used or saved before."""
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    Cuts the lineage, survives lost executors, and leaves a plain scan below later joins, so that
    adaptive execution may split a skewed side.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that nothing reads any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """Rows whose label may not be learned from: crc32 of the id's text is divisible by 5 (a null id counts as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array<bigint> the fold, from 0, of all elements before it.

    Folds blocks of 256 so that the cost per element stays bounded in very long arrays.
    """
    block, zero = 256, F.lit(0).cast("long")
    count = F.ceil(F.size(values) / F.lit(block)).cast("int")
    blocks = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(values, b * block + 1, F.lit(block))))
    sums = F.transform(blocks, lambda p: F.aggregate(p, zero, combine))

    def one(p: Column, i: Column) -> Column:
        first = F.aggregate(F.slice(sums, F.lit(1), i), zero, combine)
        start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(p, start, lambda a, x: F.struct(combine(a.at, x).alias("at"), F.concat(a.out, F.array(a.at)).alias("out")), lambda a: a.out)

    return F.coalesce(F.flatten(F.transform(blocks, one)), F.array().cast("array<bigint>"))


#: Characters of a chunk of a text.
CHUNK = 1024


def chunks(text: Column | str) -> Column:
    """A text cut every CHUNK code points, so that stretch() need not count from its start for each stretch of it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def stretch(cut: Column | str, start: Column, end: Column) -> Column:
    """The code points start..end (exclusive) of a text given by its chunks."""
    first = F.floor(start / CHUNK).cast("int")
    held = F.slice(cut, first + 1, (F.floor((end - 1) / CHUNK) - first + 1).cast("int"))
    return F.when(end <= start, F.lit("")).otherwise(F.substring(F.array_join(held, ""), (start % CHUNK).cast("int") + 1, (end - start).cast("int")))


def find_spans(df: DataFrame, text: str, regex: str, out: str, group: int = 0) -> DataFrame:
    """Add column `out`: the leftmost non-overlapping matches of regex in df[text], built from split() and regexp_extract_all().

    Each is struct(start, end, hit, part): code points with an exclusive end, the match and its capture `group`.
    """
    seen = F.col(text).rlike(regex)
    none = F.array().cast("array<string>")
    df = df.withColumn(f"{out}_h", F.when(seen, F.regexp_extract_all(text, F.lit(regex), F.lit(0))).otherwise(none))
    df = df.withColumn(f"{out}_p", F.when(seen, F.regexp_extract_all(text, F.lit(regex), F.lit(group))).otherwise(none) if group else F.col(f"{out}_h"))
    gaps = F.when(seen, F.slice(F.split(text, regex, -1), F.lit(1), F.size(f"{out}_h"))).otherwise(none)
    df = df.withColumn(f"{out}_g", F.transform(gaps, lambda g: F.length(g).cast("long")))
    # A match starts after all gaps up to it and all matches before it.
    df = df.withColumn(f"{out}_s", running(F.zip_with(f"{out}_g", f"{out}_h", lambda g, h: g + F.length(h)), lambda a, x: a + x))
    zipped = F.arrays_zip(f"{out}_s", f"{out}_h", f"{out}_p", f"{out}_g")

    def span(z: Column) -> Column:
        start = z[f"{out}_s"] + z[f"{out}_g"]
        return F.struct(start.alias("start"), (start + F.length(z[f"{out}_h"])).alias("end"), z[f"{out}_h"].alias("hit"), z[f"{out}_p"].alias("part"))

    return df.withColumn(out, F.transform(zipped, span)).drop(f"{out}_h", f"{out}_p", f"{out}_g", f"{out}_s")


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
