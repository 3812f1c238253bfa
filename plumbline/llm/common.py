"""Helpers shared by the training-data operators.

Nothing here collects documents, links or fingerprints to the driver.  Lineage is cut by writing Parquet tables
into the shared folder that the cluster names in ``spark.checkpoint.dir``; every executor can reread them after a
loss.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.staging import discard as discard
from plumbline.staging import staged as stage  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 8) -> None:
    """Bound an Arrow batch by rows and bytes, so that a worker never holds many long texts at once.

    The settings stay with the session: plans run later than they are made.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def by_rows(df: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """``mapInArrow`` over the named columns only: ``fn(dict of column -> pyarrow array)`` gives a dict of columns.

    Extra input columns, whatever their names, are dropped before Python sees them.
    """
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn({c: batch.column(i) for i, c in enumerate(columns)})
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return df.select(*columns).mapInArrow(run, schema)


def rows_kept(docs: DataFrame, keep) -> DataFrame:
    """The rows, with all their columns, for which ``keep(columns by name)`` (a boolean array for a batch) is true."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep({c: batch.column(i) for i, c in enumerate(names)})))

    return docs.mapInArrow(run, docs.schema)


def unused(name: str, taken: list[str]) -> str:
    """``name``, with bars after it until no column has it (names are compared without regard to case)."""
    lowered = {x.lower() for x in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is an empty one."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


#: texts on which an encoder's shortcuts are held against its library when a tokenizer is loaded
PROBES = (
    "", " ", "one", "  Two  words\n\nand\tTABS \r\n", "don't we'LL I'm they'Ve 'S", "x,y.z!(a)[b]{c}#1 $2 50% a-b_c/d\\e", "3.14159 12345678 1e9", "éÉ ß Straße İ ﬁn naïve",
    "你好 世界。 привет мир", "\U0001f600\u200b\ufeff\u3000x", "▁a ▁ b▁", "<|endoftext|> a<|startoftext|>b </s> <s> <unk> <0x41>", "=====------ ......, ,,,;;; \"'`~", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
)


class Memo(dict):
    """word -> value, computed on a miss; emptied when full and long keys are never kept, so its size is bounded.

    ``memo.__getitem__`` runs in C for keys that are present, so ``map(memo.__getitem__, words)`` is cheap.
    """

    def __init__(self, make, limit: int = 400_000, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
