"""Token totals by source, language and tokenizer version, maintained from signed changes."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table
from .tokens import VOCABULARY, Encoder

KEYS = ("source", "lang", "tokenizer")
SUMS = ("documents", "tokens", "characters")
DELTA = ", ".join([*(f"{k} string" for k in KEYS), *(f"{s} long" for s in SUMS)])


def with_token_counts(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """df (with a text column) without its text, and with n_tokens and n_characters; null text has 0."""
    kept = [c for c in df.columns if c not in ("text", "n_tokens", "n_characters")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*kept).dtypes), "n_tokens long", "n_characters long"])

    def count(batches):
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            texts = batch.text.fillna("").tolist()
            yield batch[kept].assign(n_tokens=encoder.count(texts), n_characters=[len(t) for t in texts])

    return df.select(*kept, "text").mapInPandas(count, schema)


class TokenLedger:
    """Additive totals under a folder: a rolled-up table, and a small one for each batch committed since.

    A batch is summed to a row for each (source, lang, tokenizer) that it touches, written aside,
    and renamed to its id. The rename refuses a name that exists, so committing a batch again, after
    a lost driver or by two at once, changes nothing. compact() rolls batches up into the next
    generation of totals, with the ids that it holds; it too takes effect by one rename.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        fs = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._jpath = fs.Path
        self._fs = self._jpath(path).getFileSystem(conf)
        self._context = fs.FileContext.getFileContext(self._jpath(path).toUri(), conf)
        self._plain = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)

    def _settle(self, aside, final: str) -> bool:
        """Renames aside to final and tells whether it could; false, and aside is gone, where final exists."""
        self._fs.mkdirs(self._jpath(self.path))
        try:
            self._context.rename(aside, self._jpath(f"{self.path}/{final}"), self._plain)
            return True
        except Py4JJavaError as e:
            self._fs.delete(aside, True)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()) or self._fs.exists(self._jpath(f"{self.path}/{final}")):
                return False
            raise

    def _named(self, prefix: str) -> list[str]:
        """What follows the prefix in the names of the folder's entries."""
        root = self._jpath(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))

    def _rolled(self) -> tuple[int, set[str]]:
        """The last generation, 0 if there is none, and the ids of the batches that it holds."""
        last = max(map(int, self._named("generation=")), default=0)
        if not last:
            return 0, set()
        return last, {r.id for r in self.spark.read.schema("id string").parquet(f"{self.path}/generation={last}/ids").collect()}

    def _aside(self):
        return self._jpath(f"{self.path}/.aside-{uuid.uuid4().hex}")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """changes: sign (+1 insert, -1 delete), source, lang, tokenizer, n_tokens, n_characters.

        A revised document is its old counts with -1 and its new ones with +1. Null keys are a
        group; null counts add nothing; repeated rows count each; an empty batch is committed and
        adds nothing; other columns are not read. False if the batch had been committed before.
        """
        if self._fs.exists(self._jpath(f"{self.path}/batch={batch_id}")):
            return False
        signed = lambda c: F.sum(F.col("sign") * F.coalesce(F.col(c), F.lit(0))).cast("long")
        summed = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("documents"), signed("n_tokens").alias("tokens"), signed("n_characters").alias("characters"))
        aside = self._aside()
        summed.write.parquet(aside.toString())
        return self._settle(aside, f"batch={batch_id}")

    def _sums(self) -> tuple[DataFrame, list[str]]:
        """Totals of all, and the ids of the batches that aren't rolled up yet."""
        last, held = self._rolled()
        fresh = [i for i in self._named("batch=") if i not in held]
        paths = [f"{self.path}/batch={i}" for i in fresh] + ([f"{self.path}/generation={last}/totals"] if last else [])
        deltas = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return deltas.groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS]), fresh

    def totals(self) -> DataFrame:
        """Groups whose documents have all been deleted again are left out."""
        return self._sums()[0].where("documents <> 0 OR tokens <> 0 OR characters <> 0")

    def compact(self) -> bool:
        """Rolls all batches up; their names stay, so that none is committed again. False if there was nothing to do or another was first."""
        last, held = self._rolled()
        sums, fresh = self._sums()
        if not fresh:
            return False
        aside = self._aside()
        sums.write.parquet(f"{aside.toString()}/totals")
        self.spark.createDataFrame([(i,) for i in sorted(held | set(fresh))], "id string").write.parquet(f"{aside.toString()}/ids")
        if not self._settle(aside, f"generation={last + 1}"):
            return False
        for i in fresh:  # the empty folder is what refuses the id
            for s in self._fs.listStatus(self._jpath(f"{self.path}/batch={i}")):
                self._fs.delete(s.getPath(), True)
        return True


def op2_token_counts(spark, sf_dir):
    """All documents inserted; then exact copies of earlier ones deleted; then documents with
    repeated lines revised to those without; each batch is committed twice, which counts once, and
    the first two are rolled up before the third.

    Null texts have no tokens and are nobody's copies; of equal texts the one with the smallest id
    stays; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    version = VOCABULARY.rpartition(".")[0]
    lines = F.split(F.col("text"), "\n", -1)
    revised_text = F.array_join(F.array_distinct(lines), "\n")
    counted = materialize(
        with_token_counts(docs.select("doc_id", "source", "lang", "text", F.sha2("text", 256).alias("digest"), (F.size(F.array_distinct(lines)) < F.size(lines)).alias("repeats")))
        .withColumn("tokenizer", F.lit(version)), "tokens-counted",
    )
    # written, so that the joins see two shuffles and can split a frequent text
    firsts = materialize(counted.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id")), "tokens-firsts").hint("merge")
    later = counted.join(firsts, "digest").where(F.col("doc_id") > F.col("first_id"))
    kept = counted.where("repeats").join(firsts, "digest").where(F.col("doc_id") == F.col("first_id"))
    anew = docs.where(F.size(F.array_distinct(lines)) < F.size(lines)).select("doc_id", "source", "lang", revised_text.alias("text"))
    anew = with_token_counts(anew).join(kept.select("doc_id"), "doc_id", "left_semi").withColumn("tokenizer", F.lit(version))

    ledger = TokenLedger(spark, f"{shared_dir(spark)}/token-ledger-{uuid.uuid4().hex}")
    sign = lambda df, s: df.withColumn("sign", F.lit(s))
    revisions = sign(kept, -1).unionByName(sign(anew, 1), allowMissingColumns=True)
    for batch_id, changes in (("inserted", sign(counted, 1)), ("copies-deleted", sign(later, -1)), ("lines-revised", revisions)):
        if batch_id == "lines-revised":
            ledger.compact()
        ledger.commit(batch_id, changes)
        ledger.commit(batch_id, changes)
    return ledger.totals()
