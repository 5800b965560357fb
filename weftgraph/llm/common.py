"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType

#: Records and bytes of one Arrow batch: with texts of 100 kB a batch stays near 16 MB.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so a Python worker's memory does not follow the row width."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where that is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, lost executors cost nothing.

    For results that outlive the call; what only the call itself needs goes to a :class:`Scratch`.
    """
    return _write(df, f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Tables of one computation, in a folder of their own under the shared one; gone when the block ends.

    ``scratch(df, label)`` writes and reads again; ``drop`` deletes tables that are no longer needed earlier.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.made = 0

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}-{label}"
        made = _write(df, path)
        made._scratch_path = path
        return made

    def drop(self, *made: DataFrame) -> None:
        for df in made:
            delete_folder(self.spark, df._scratch_path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete_folder(self.spark, self.root)
        # Shuffle files go when the driver's garbage collection finds their owners unreachable.
        self.spark.sparkContext._jvm.System.gc()


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """The named columns of each Arrow batch as Python lists, in the order asked for."""
    for batch in batches:
        yield [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def map_arrow(df: DataFrame, make: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` after the batches are bounded; ``make`` gets an iterator of record batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(make, schema)


def squeeze(df: DataFrame) -> DataFrame:
    """``df`` with each whole ``text`` as a Zstandard frame (null: null), for shuffles of whole texts; :func:`unsqueeze` undoes it."""
    at = df.columns.index("text")

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            yield batch.set_column(at, "text", pa.array([packer.compress(t.as_buffer()) if t.is_valid else None for t in texts], pa.binary()))

    return map_arrow(df, run, StructType([StructField("text", BinaryType()) if k == at else f for k, f in enumerate(df.schema)]))


def unsqueeze(texts: pa.Array) -> list[str | None]:
    reader = zstandard.ZstdDecompressor()
    return [reader.decompress(t.as_buffer()).decode("utf-8") if t.is_valid else None for t in texts]


def by_group(df: DataFrame, keys: list[str], make: Callable, schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """The rows that ``make`` returns for each group of equal keys.

    ``make`` gets a dict of column name to list and returns the lists of ``schema``'s columns. One shuffle and
    a sort inside the partitions; a task holds one group and one batch, so callers bound their groups.
    """
    names = df.columns
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)]

    def run(batches):
        held: list[list] = [[] for _ in names]
        at = [names.index(k) for k in keys]

        def made(cuts: list[int]) -> pa.RecordBatch:
            out: list[list] = [[] for _ in arrow]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                for o, new in zip(out, make({n: h[lo:hi] for n, h in zip(names, held, strict=True)}), strict=True):
                    o += new
            return pa.RecordBatch.from_arrays([pa.array(o, t) for o, (_, t) in zip(out, arrow, strict=True)], names=[n for n, _ in arrow])

        for columns in rows(batches, *names):
            for h, new in zip(held, columns, strict=True):
                h += new
            tags = list(zip(*(held[k] for k in at), strict=True))
            cuts = [0, *(i for i in range(1, len(tags)) if tags[i] != tags[i - 1])]
            if cuts[-1]:
                yield made(cuts)
                held = [h[cuts[-1] :] for h in held]
        if held[0]:
            yield made([0, len(held[0])])

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys, *order), run, schema)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc_bucket(column, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus`` (the fold of a row)."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
