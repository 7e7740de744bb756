"""Sharding by size-tiered compaction, in DataFrame functions alone.

A store is a folder of immutable shards and of versioned manifests.  ``append`` writes
arrivals as small shards, one or more for each task, with no shuffle.  ``compact`` looks at
the manifest alone: shards belong to tiers by size, each tier so many times the one before;
a tier with enough shards has them merged, in the order they came, into shards of the
target size at most.  Either ends by publishing a finished manifest under the next version:
a small file that names it comes into being whole, and not at all if another writer
has published that version; readers see the version before or after, and shards that no
manifest names are leftovers.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import checkpointed

TARGET_BYTES, FIRST_TIER_BYTES, FAN_IN, ARRIVALS = 64 << 20, 1 << 20, 4, 16
_MANIFEST = "shard string, bytes long, rows long, tier int, born long"


def isinstance_of(error: Py4JJavaError, name: str) -> bool:
    return error.java_exception.getClass().getName() == name


class Store:
    """Shards and manifests under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, first_tier_bytes: int = FIRST_TIER_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.first, self.fan_in = spark, root.rstrip("/"), target_bytes, first_tier_bytes, fan_in
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(self._conf)

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        names = self._fs.globStatus(self._path(f"{self.root}/manifests/v*"))
        return max((int(s.getPath().getName()[1:]) for s in names or []), default=0)

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:08d}"

    def manifest(self, version: int | None = None) -> DataFrame:
        """Rows (shard, bytes, rows, tier, born); shard is a path under the root, born the version that it came with."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        folder = self.spark.read.text(self._name(version)).first()["value"]
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/{folder}")

    def _open(self, files: DataFrame) -> DataFrame:
        """The rows of the files (shard, ...), and these columns; no other file is touched.  Their names go through the driver, as those of any files that Spark reads."""
        names = [r["shard"] for r in files.select("shard").orderBy("shard").collect()]
        if not names:
            raise ValueError(f"{self.root} has no such shards")
        rows = self.spark.read.parquet(*[f"{self.root}/{n}" for n in names])
        place = F.regexp_extract(F.col("_metadata.file_path"), "(shards/.*)$", 1)
        return rows.withColumn("shard", place).join(files, "shard")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with the columns shard and tier."""
        return self._open(self.manifest(version).select("shard", "tier"))

    def _sized(self, folder: str, born: int) -> DataFrame:
        rows = self.spark.read.schema("row_count int").parquet(f"{self.root}/{folder}").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        rows = rows.groupBy("path", "bytes").agg(F.count("*").alias("rows"))
        tier = F.greatest(F.lit(0), F.ceil(F.log(float(self.fan_in), F.col("bytes") / self.first))).cast("int")
        return rows.select(F.regexp_extract("path", "(shards/.*)$", 1).alias("shard"), "bytes", "rows", tier.alias("tier"), F.lit(born).cast("long").alias("born"))

    def _publish(self, text: str, target: str) -> bool:
        """Make the file target with this text, whole at once; false if it is there already, whoever made it and whenever."""
        aside = self._path(f"{target.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.writeBytes(text)
        out.close()
        if self._fs.getUri().getScheme() == "file":  # a link to an existing name fails in the file system itself
            nio, bare = self._jvm.java.nio.file, lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                nio.Files.createLink(bare(self._path(target)), bare(aside))
                return True
            except Py4JJavaError as e:
                if not isinstance_of(e, "java.nio.file.FileAlreadyExistsException"):
                    raise
                return False
            finally:
                self._fs.delete(aside, False)
        # Elsewhere a rename without overwriting, which the file system must do in one step, as HDFS does.
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        never = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(aside, self._path(target), never)
            return True
        except Py4JJavaError as e:
            if not isinstance_of(e, "org.apache.hadoop.fs.FileAlreadyExistsException"):
                raise
            self._fs.delete(aside, False)
            return False

    def _commit(self, manifest: DataFrame, version: int) -> int:
        """Write a manifest and publish it as this version; an error if that version exists already."""
        folder = f"m-{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(f"{self.root}/manifests/{folder}")  # one row for each shard
        if not self._publish(folder, self._name(version)):
            self._fs.delete(self._path(f"{self.root}/manifests/{folder}"), True)
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def append(self, rows: DataFrame, max_rows: int = 0, by: str | None = None) -> int:
        """Write rows as new small shards, of max_rows at most if that is set, and commit.  An empty arrival commits nothing.

        With by, a column of a bounded number of whole numbers, rows are written once and
        each number is an arrival of its own, committed in their order; by is stored, too.
        """
        born = self.version() + 1
        folder = f"shards/{born:08d}-{uuid.uuid4().hex[:8]}"
        writer = rows.write if by is None else rows.withColumn("batch", F.col(by)).write.partitionBy("batch")
        writer = writer.option("compression", "zstd")
        (writer.option("maxRecordsPerFile", max_rows) if max_rows else writer).parquet(f"{self.root}/{folder}")
        new = self._sized(folder, born)
        if by is None:
            return born - 1 if new.isEmpty() else self._commit(self.manifest(born - 1).unionByName(new), born)
        sized = checkpointed(new.withColumn("batch", F.regexp_extract("shard", "/batch=([^/]*)/", 1).cast("long")))
        for k in sorted(r["batch"] for r in sized.select("batch").distinct().collect()):
            mine = sized.where(F.col("batch") == k).drop("batch").withColumn("born", F.lit(born).cast("long"))
            born = self._commit(self.manifest(born - 1).unionByName(mine), born) + 1
        return born - 1

    def plan(self, version: int | None = None) -> DataFrame:
        """Rows (shard, bytes, target): the merges due in the newest version, from the manifest alone.

        In a tier of fan_in shards or more, shards are laid end to end in the order of
        (born, shard) and cut wherever a multiple of the target size falls; pieces of one shard stay.
        """
        now = self.manifest(version).where(F.col("bytes") * 2 <= self.target)
        due = now.groupBy("tier").count().where(F.col("count") >= self.fan_in).select("tier")
        line = Window.partitionBy("tier").orderBy("born", "shard").rowsBetween(Window.unboundedPreceding, -1)
        cut = now.join(due, "tier").withColumn("target", F.concat_ws("-", F.col("tier"), F.floor((F.coalesce(F.sum("bytes").over(line), F.lit(0)) + F.col("bytes") / 2) / self.target)))
        return cut.withColumn("members", F.count("*").over(Window.partitionBy("target"))).where("members > 1").select("shard", "bytes", "target")

    def compact(self) -> int:
        """Merge what is due until nothing is; the newest version then.  Each round writes each merged row once and commits once."""
        while True:
            before = self.version()
            plan = checkpointed(self.plan(before))
            targets = plan.select("target").distinct()
            merges = targets.count()
            if not merges:
                return before
            born = before + 1
            folder = f"shards/{born:08d}-{uuid.uuid4().hex[:8]}"
            task = targets.withColumn("task", (F.row_number().over(Window.orderBy("target")) - 1).cast("int"))  # a row for each file to be written
            rows = self._open(plan.select("shard", "target").join(task, "target")).drop("shard")
            # Each target has a task of its own, which writes it to one file; the target size bounds both.
            rows.repartitionById(merges, "task").drop("task").write.option("compression", "zstd").partitionBy("target").parquet(f"{self.root}/{folder}")
            new = self._sized(folder, born)
            self._commit(self.manifest(before).join(plan, "shard", "left_anti").unionByName(new), born)

    def vacuum(self) -> int:
        """Delete folders of shards that the newest version doesn't name; how many.  Not while others write or read older versions."""
        used = {r["f"] for r in self.manifest().select(F.regexp_extract("shard", "^shards/([^/]*)/", 1).alias("f")).distinct().collect()}
        folders = self._fs.globStatus(self._path(f"{self.root}/shards/*")) or []
        gone = [s.getPath() for s in folders if s.getPath().getName() not in used]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def shard_documents(docs: DataFrame, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, arrivals: int = ARRIVALS) -> DataFrame:
    """The rows of docs read back from a new store under root, and the columns arrival, shard, tier and version.

    Documents come in so many arrivals, by their id, and are compacted then.  Every row is in
    one shard, whatever its values: nulls, repeated rows, equal ids and columns stay as they
    are; columns of the names above, batch, target and task are stored with ``document_`` in
    front.  Rows without an id come first.  No documents give no rows.
    """
    ours = ("arrival", "batch", "shard", "tier", "version", "target", "task")
    named = docs.withColumnsRenamed({c: f"document_{c}" for c in docs.columns if c.lower() in ours})
    named = named.withColumn("arrival", F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(arrivals)), F.lit(0)).cast("long"))
    store = Store(docs.sparkSession, root, target_bytes, fan_in=fan_in)
    store.append(named, by="arrival")
    if not store.version():
        return named.limit(0).withColumns({"shard": F.lit(""), "tier": F.lit(0), "version": F.lit(0).cast("long")})
    version = store.compact()
    store.vacuum()
    return store.read(version).withColumn("version", F.lit(version).cast("long"))
