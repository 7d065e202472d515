"""Helpers that several of the training-data operators use."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files of the public tokenizers lie; ``pack`` takes another path as a parameter.
TOKENIZER_FILE = "word_bpe_49k.json"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where none is set one set here, in the
    warehouse; only a local session, whose executors are this machine, gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="arborscale-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/arborscale-scratch")
        found = spark.sparkContext.getCheckpointDir()
    return found


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once a session, so that they import it wherever they run."""
    context = spark.sparkContext
    if not any(Path(f).name.startswith("arborscale-code") for f in context.listFiles):
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="arborscale-")) / "arborscale-code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(archive))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it read back: lineage ends there, so a lost
    executor costs a re-read and not a re-computation, and what is used twice is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arborscale-{name}-{uuid.uuid4().hex}"
    ship(spark)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PLACES[id(back)] = (weakref.ref(back), path)
    return back


#: Where written tables lie, as long as their frames are in use.
_PLACES: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        known, path = _PLACES.pop(id(df), (lambda: None, ""))
        if known() is df:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


#: How to forget what operators remember in this worker, by what it is.
_FORGET: dict[str, Callable[[], None]] = {}


def remember_only(what: str, forget: Callable[[], None] | None = None) -> None:
    """Called where a task begins. A worker goes from one operator to the next, so whatever else than ``what`` is remembered in it
    (words, units, hashes) is forgotten, and pages that Arrow keeps go back. ``forget`` is called when another operator begins."""
    for other in [x for x in _FORGET if x != what]:
        _FORGET.pop(other)()
    pa.default_memory_pool().release_unused()
    if forget:
        _FORGET[what] = forget


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(column: str = "doc_id", parts: int = 5) -> Column:
    """``crc32`` of the id as text, modulo ``parts``: the fold that learning and held-out rows go by. A null id
    counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts
