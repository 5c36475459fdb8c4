"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The code points of the Unicode White_Space property, as a regex class body.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Words of the contracts that split on ASCII white space only.
ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Texts beyond this many characters are worked through in pieces.
LONG_TEXT = 1 << 20

_CUT = re.compile(f"(?<=[^{WHITE}])(?= [^{WHITE}])")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> str:
    """A-Z to a-z; every other character stays."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def blocks(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Pieces of about ``size`` characters, cut only before a single blank between two words."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local
    master gets a temporary folder, as in tests; a cluster gets an error, as its
    machines would not see each other's files.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base and not re.fullmatch(r"local(\[[^,\]]*(,[^,\]]*)?\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows.

    The shuffle files behind what is written are of no more use; they go when the
    driver's JVM collects its garbage, which is asked for here, as loops would
    else hold them all.
    """
    shared_folder(df.sparkSession)
    written = df.checkpoint(eager=True)
    df.sparkSession.sparkContext._jvm.System.gc()
    return written


class Written:
    """A DataFrame as Parquet in the shared folder: written once, read as often as wanted, deleted by ``drop``."""

    def __init__(self, df: DataFrame, by: tuple[str, ...] = ()):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_folder(self.spark)}/rows-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(*by).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def by_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that turns each batch into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work(batch)

    return run


def carried(docs: DataFrame, carry: str | None) -> tuple[list[Column], T.StructType]:
    """What to select, and the schema to add, for an operator that hands its rows through as a struct named ``carry``."""
    if carry is None:
        return [], T.StructType([])
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(carry))
    return [F.struct(*[docs[c] for c in docs.columns]).alias(carry)], whole.schema


def ddl(text: str) -> T.StructType:
    """A schema from its short form."""
    return T._parse_datatype_string(text)


_resident: dict = {}


def resident(key: tuple, make: Callable):
    """What a worker keeps between tasks: one operator's tables at a time.

    Workers are used again by the next operator; asking for its tables lets go of
    those of the last one, so a pipeline needs no more memory than its largest stage.
    """
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]
