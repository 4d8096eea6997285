"""What every operator needs of the session: shared work folders, shipped code, column names that don't clash."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_COMPILED: dict[tuple, object] = {}
#: Bytes of an Arrow batch, so that a worker's memory doesn't follow the length of the texts in it.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application, so that functions pickled by name load there.

    Arrow batches of the session are bounded by BATCH_BYTES, unless it has a bound below Spark's default already.
    """
    app = spark.sparkContext.applicationId
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tarnsight-ship-")
    target = os.path.join(folder, "tarnsight_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for root, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def java_object(spark: SparkSession, name: str, source: str):
    """A new object of a Java class in the driver, whose class the executors get too. Compiled once per application, by Spark's own Janino."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    if (sc.applicationId, name) not in _COMPILED:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source)
        target = os.path.join(tempfile.mkdtemp(prefix="tarnsight-java-"), f"{name}.jar")
        with zipfile.ZipFile(target, "w") as z:
            for part, code in compiler.getBytecodes().items():
                z.writestr(part.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(target)
        _COMPILED[sc.applicationId, name] = compiler.getClassLoader().loadClass(name)
    return _COMPILED[sc.applicationId, name].getDeclaredConstructors()[0].newInstance(sc._gateway.new_array(jvm.java.lang.Object, 0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir of the session; a temporary one only in local mode where it is unset."""
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master", "").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tarnsight-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's API for a path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors. Removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnsight/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = hadoop_path(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnsight_path = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/tarnsight/{name}-{uuid.uuid4().hex}"
    fs, at = hadoop_path(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def discard(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more."""
    path = getattr(df, "_tarnsight_path", None)
    if path:
        fs, at = hadoop_path(df.sparkSession, path)
        fs.delete(at, True)


def set_aside(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename columns that clash (in any case) with names an operator adds: `shard` becomes `shard_in`, `shard_in_in`, and so on."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    new = []
    for c in df.columns:
        to = c
        if c.lower() in {n.lower() for n in names}:
            while to.lower() in taken:
                to += "_in"
            taken.add(to.lower())
        new.append(to)
    return df.toDF(*new) if new != df.columns else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it until no column of df has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def column_or_null(df: DataFrame, name: str, kind: str):
    """The named column cast to a type, or nulls of that type where df has no such column."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)
