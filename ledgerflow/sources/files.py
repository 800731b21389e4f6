"""File sources and sinks: CSV, TSV, JSON, Parquet, whole folders."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = " \t\r\n"
REQUIRED = ("user_id", "timestamp", "amount")
OPTIONAL = ("transaction_id", "direction", "merchant_raw", "description", "category", "source", "currency")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a local one only where none is set and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: steps are written to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back, so that what reads it twice doesn't work it out twice."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a step that stored() wrote, once nothing will read it again."""
    files = df.inputFiles()
    df.unpersist()
    for folder in {f.rsplit("/", 1)[0] for f in files}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _complete(df: DataFrame, cleanup: bool = False) -> DataFrame:
    if cleanup:
        df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.withColumns({c: F.lit(None).cast("string") for c in OPTIONAL if c not in df.columns})


def read_csv(spark: SparkSession, path, sep: str = ",", cleanup: bool = False) -> DataFrame:
    return _complete(spark.read.option("header", True).option("recursiveFileLookup", True).csv(path, sep=sep), cleanup)


def json_texts(spark: SparkSession, path) -> DataFrame:
    """(file, record): the JSON texts under path, a line or a whole file each, as each file is written.

    A file in which half of the lines are JSON by themselves has a record a line. Any other is one
    document, if it is JSON as a whole; if not, it has a record a line, most of them broken.
    """
    reader = lambda p, wholetext=False: spark.read.option("recursiveFileLookup", True).text(p, wholetext=wholetext).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("record"))
    text = F.trim("record", F.lit(_BLANK))
    ends = (text.startswith("{") & text.endswith("}")) | (text.startswith("[") & text.endswith("]"))  # the parser stops at the end of a value, whatever follows
    whole = ends & F.try_parse_json("record").isNotNull()
    lines = reader(path).where(text != "")
    per_file = lines.groupBy("file").agg(F.avg(whole.cast("int")).alias("share"))
    maybe = [r["file"] for r in per_file.where("share < 0.5").select("file").collect()]  # names of files, which the driver lists anyway
    if not maybe:
        return lines
    documents = [r["file"] for r in reader(maybe, wholetext=True).where(whole).select("file").collect()]
    if not documents:
        return lines
    named = F.broadcast(spark.createDataFrame([(f,) for f in documents], "file string"))
    return lines.join(named, "file", "left_anti").unionByName(reader(documents, wholetext=True))


def _type(spark: SparkSession, shown: str) -> T.DataType:
    """The type that schema_of_variant_agg() shows; what differs between records, or is always null, is text."""
    ddl = re.sub(r"\bDECIMAL\(\d+, ?\d+\)", "DOUBLE", re.sub(r"\b(VARIANT|VOID)\b", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", shown)))
    return spark.sql(f"SELECT CAST(NULL AS {ddl}) AS x").schema["x"].dataType


def _parsed(spark: SparkSession, path) -> tuple[DataFrame, list[str]]:
    """(file, record, parsed) with the records' objects, null where a record is no object or array of objects; and the objects' fields."""
    d = json_texts(spark, path)
    d = d.withColumn("listed", F.when(F.ltrim("record", F.lit(_BLANK)).startswith("{"), F.concat(F.lit("["), "record", F.lit("]"))).otherwise(F.col("record")))
    shown = d.where(F.ltrim("listed", F.lit(_BLANK)).startswith("[")).agg(F.schema_of_variant_agg(F.try_parse_json("listed"))).first()[0]
    kind = _type(spark, shown or "VOID")
    top = {f.name: f.dataType for f in kind.elementType} if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else {}
    inner = top.pop("transactions", None)
    fields = dict(top)
    if isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.StructType):
        for f in inner.elementType:
            fields[f.name] = f.dataType if fields.get(f.name, f.dataType) == f.dataType else T.StringType()
    record = T.StructType([T.StructField(k, t) for k, t in fields.items()])
    parsed = T.ArrayType(T.StructType([*record.fields, T.StructField("transactions", T.ArrayType(record))]))
    return d.select("file", "record", F.from_json("listed", parsed).alias("parsed")), list(fields)


def read_json(spark: SparkSession, path) -> DataFrame:
    """Objects, arrays of objects, or objects with a `transactions` array: one a line, or whole documents over many lines.

    Each file by itself decides which. Broken records give no rows; rejected_json() has them.
    """
    d, fields = _parsed(spark, path)
    d = d.select(F.explode("parsed").alias("t")).select(F.explode(F.coalesce("t.transactions", F.array(F.struct(*[F.col(f"t.`{k}`").alias(k) for k in fields])))).alias("t"))
    return _complete(d.select("t.*"))


def rejected_json(spark: SparkSession, path) -> DataFrame:
    """(file, record) of what read_json() can't read: broken lines, broken documents, and JSON that is no object."""
    d, _ = _parsed(spark, path)
    return d.where("parsed IS NULL").select("file", "record")


def read_folder(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """All files of known kinds under a folder, by name of columns; an error if there are none."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files, found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, recursive), {}
    while files.hasNext():
        name = files.next().getPath().toString()
        found.setdefault(name.rpartition(".")[2].lower(), []).append(name)
    readers = {"csv": read_csv, "tsv": lambda s, p: read_csv(s, p, "\t"), "json": read_json, "parquet": lambda s, p: _complete(s.read.parquet(*p))}
    parts = [reader(spark, found[kind]) for kind, reader in readers.items() if kind in found]
    if not parts:
        raise FileNotFoundError(f"no readable files under {path}")
    every = [d.select(*[F.col(c).cast("string").alias(c) for c in d.columns]) for d in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every)


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    (df.write.mode("overwrite").option("header", True).csv if kind == "csv" else df.write.mode("overwrite").json)(path)
