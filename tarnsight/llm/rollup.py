"""Token counts kept as delta-maintained rollups.

A change says what a document's count was and what it is: an insert has no old side, a delete no new one, a revision both (its source
or language may change with it). Each side is a signed row, minus the old and plus the new; a batch's rows are summed by source, language
and tokenizer version before they are stored, so a batch is as small as the number of groups that it touches. Totals are the sum of all
committed batches: additive, and in any order.

A batch is committed once: its sums are written to a folder of their own, then one file that names that folder gets the batch's name, by
a move that an existing file refuses (a hard link on a local disk; elsewhere a rename without overwriting, which is atomic on HDFS and as
good as the file system's promise on others). A batch committed before changes nothing; a writer that died leaves a folder that no reader
sees, and its batch can be run again. `compact` publishes a base that stands for the batches up to now, by the same kind of commit, under
a name that follows from them. Nothing is removed, and readers take of bases that overlap only the one with more batches: compactors that
run at the same time, or from an old listing, change no total.

Defined results: null source, language and text are values (a null or empty text has 0 tokens). Texts of any length are counted whole.
Repeated change rows count each: a change table holds each change once; so does each of repeated documents. `revisions` goes by doc_id:
rows with a null doc_id can't be told apart and are in no revision. Groups whose documents and tokens both come to 0 are left out of
totals. An empty batch or table commits and changes nothing. Other columns are ignored, also such as clash with the output's names.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import hadoop_path, shared_dir, ship
from . import bpe
from . import textvec as tv

KEYS = ["source", "lang", "tokenizer_version"]
CHANGE = "old_source string, old_lang string, old_tokens long, new_source string, new_lang string, new_tokens long, tokenizer_version string"
_SUMS = "source string, lang string, tokenizer_version string, documents long, tokens long"


def count_tokens(docs: DataFrame, column: str = "text", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, n_tokens) of every row, by the byte-level BPE vocabulary."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(bpe.read_vocabulary(vocabulary))

    def run(batches):
        for b in batches:
            for first, buf, off in tv.pieces(b.column("text"), 1 << 20):
                _, at = bpe.engine(sent.value).encode(buf, off)
                n = len(off) - 1
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(first, n) for c in ("doc_id", "source", "lang")), pa.array(np.diff(at))], ["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang")), F.col(column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long")


def inserts(counts: DataFrame, version: str) -> DataFrame:
    """Changes that add the documents of counts."""
    return counts.selectExpr("cast(null as string) old_source", "cast(null as string) old_lang", "cast(null as bigint) old_tokens", "source new_source", "lang new_lang", "n_tokens new_tokens", f"'{version}' tokenizer_version")


def deletes(counts: DataFrame, version: str) -> DataFrame:
    """Changes that take the documents of counts away."""
    return counts.selectExpr("source old_source", "lang old_lang", "n_tokens old_tokens", "cast(null as string) new_source", "cast(null as string) new_lang", "cast(null as bigint) new_tokens", f"'{version}' tokenizer_version")


def revisions(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """Changes of the documents, by doc_id, whose count, source or language differ between two tables of counts with unique ids."""
    o = old.select("doc_id", F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.col("n_tokens").alias("old_tokens"))
    n = new.select("doc_id", F.col("source").alias("new_source"), F.col("lang").alias("new_lang"), F.col("n_tokens").alias("new_tokens"))
    same = "old_source <=> new_source and old_lang <=> new_lang and old_tokens <=> new_tokens"
    return o.join(n, "doc_id").where(f"not ({same})").drop("doc_id").withColumn("tokenizer_version", F.lit(version)).select(*[c.split()[0] for c in CHANGE.split(", ")])


def signed_sums(changes: DataFrame) -> DataFrame:
    """(source, lang, tokenizer_version, documents, tokens): a batch's net effect."""
    side = lambda which, sign: F.when(F.col(f"{which}_tokens").isNotNull(), F.struct(F.col(f"{which}_source").alias("source"), F.col(f"{which}_lang").alias("lang"), F.lit(sign).cast("long").alias("documents"), (F.lit(sign) * F.col(f"{which}_tokens")).cast("long").alias("tokens")))
    rows = changes.select("tokenizer_version", F.explode(F.array(side("old", -1), side("new", 1))).alias("s")).where("s is not null")
    return rows.groupBy(F.col("s.source").alias("source"), F.col("s.lang").alias("lang"), "tokenizer_version").agg(F.sum("s.documents").alias("documents"), F.sum("s.tokens").alias("tokens"))


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def scratch(spark: SparkSession) -> "Rollup":
        """A new one in the session's shared folder, removed when the application ends."""
        r = Rollup(spark, f"{shared_dir(spark)}/tarnsight/rollup-{uuid.uuid4().hex}")
        fs, at = hadoop_path(spark, r.path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        return r

    def _commits(self) -> dict[str, dict]:
        fs, at = hadoop_path(self.spark, f"{self.path}/commits")
        found = {}
        if fs.exists(at):
            for s in fs.listStatus(at):
                stream = fs.open(s.getPath())
                try:
                    text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                found[s.getPath().getName()] = json.loads(text)
        return found

    def _publish(self, name: str, entry: dict) -> bool:
        """Write the commit file under a name of its own, then give it its name, unless another has it: the first one to arrive wins."""
        jvm = self.spark.sparkContext._jvm
        fs, temp = hadoop_path(self.spark, f"{self.path}/staging/{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        _, target = hadoop_path(self.spark, f"{self.path}/commits/{name}")
        fs.mkdirs(target.getParent())
        try:
            if fs.getUri().getScheme() == "file":
                at = lambda p: jvm.java.nio.file.Paths.get(p.toUri())
                jvm.java.nio.file.Files.createLink(at(fs.makeQualified(target)), at(fs.makeQualified(temp)))
                fs.delete(temp, False)
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
                conf = self.spark.sparkContext._jsc.hadoopConfiguration()
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(temp, target, none)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            fs.delete(temp, False)
            return False
        return True

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False where its id was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_\-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r}")
        seen = self._commits()
        if batch_id in seen or any(batch_id in e.get("replaces", ()) for e in seen.values()):
            return False
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        signed_sums(changes).coalesce(1).write.parquet(folder)
        return self._publish(batch_id, {"folder": folder})

    def _live(self) -> dict[str, dict]:
        """The commits that make up the totals: bases that don't overlap, larger ones first, and the batches that none of them covers."""
        commits, covered, live = self._commits(), set(), {}
        for k, e in sorted(commits.items(), key=lambda x: (-len(x[1].get("replaces", ())), x[0])):
            own = set(e.get("replaces", [k]))
            if not own & covered:
                covered |= own
                live[k] = e
        return live

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, documents, tokens) of all committed batches."""
        return self._sum(self._live())

    def _sum(self, live: dict[str, dict]) -> DataFrame:
        folders = [e["folder"] for e in live.values()]
        rows = self.spark.read.schema(_SUMS).parquet(*folders) if folders else self.spark.createDataFrame([], _SUMS)
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """Replace all live batches by one base with the same totals."""
        live = self._live()
        if len(live) < 2:
            return False
        return self._compact(live)

    def _compact(self, live: dict[str, dict]) -> bool:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        self._sum(live).coalesce(1).write.parquet(folder)
        batches = sorted(b for k, e in live.items() for b in e.get("replaces", [k]))
        name = hashlib.sha256("\n".join(batches).encode()).hexdigest()
        return self._publish(f"base-{name}", {"folder": folder, "replaces": batches})
