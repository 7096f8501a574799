"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siteframe.core import cut_lineage, ship

#: White space of the word pattern [^\x20\x09-\x0D]+; also what bytes.split() splits at.
SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A broadcast table has at most so many rows and bytes of compressed files (about 50 MB as a hash table).
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 16 << 20
#: Bytes of text that a Python worker handles at once; a longer text is handled alone.
CHUNK_BYTES = 4 << 20

#: Rows that Spark hands to a Python worker at once, where the session allows more: texts may be long.
BATCH_ROWS = 512

TEXT = "__text"


def prepare(spark: SparkSession) -> None:
    """Workers know this package and get texts in small batches."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER_AZ, LOWER_AZ)


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = TEXT) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cuts record batches so that the texts of a piece have about CHUNK_BYTES; yields pieces and their texts as bytes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        start, held = 0, 0
        sizes = [len(t) if t is not None else 0 for t in (x.as_buffer() if x.is_valid else None for x in texts)]
        for i, n in enumerate(sizes):
            if held and held + n > CHUNK_BYTES:
                yield batch.slice(start, i - start), texts.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start), texts.slice(start).to_pylist()


def map_texts(df: DataFrame, text: str, schema: StructType, fn: Callable[[list], Sequence],
              keep: Sequence[Column] = ()) -> DataFrame:
    """Rows of `df` with the columns `keep` and those of `schema`, which `fn` makes of a list of texts.

    Texts come as UTF-8 bytes or None. `fn` returns one sequence (or Arrow array) for each field of `schema`.
    """
    source = df.select(*keep, F.col(text).cast("string").alias(TEXT))
    kept = [f for f in source.schema.fields if f.name != TEXT]
    out = StructType(kept + list(schema.fields))
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_chunks(batches):
            made = fn(texts)
            columns = [piece.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
            for i, values in enumerate(made, len(kept)):
                columns.append(values if isinstance(values, pa.Array) else pa.array(values, arrow.field(i).type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    prepare(df.sparkSession)
    return source.mapInArrow(run, out)


def hinted(written: DataFrame) -> DataFrame:
    """A table that `cut_lineage` wrote, with a broadcast hint if it is small.

    Small is at most BROADCAST_ROWS rows and BROADCAST_BYTES of files; a shuffle joins anything else.
    """
    sc = written.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(written._siteframe_path)
    size = path.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(written) if size <= BROADCAST_BYTES and written.count() <= BROADCAST_ROWS else written


def small_side(table: DataFrame) -> DataFrame:
    """A written copy of `table`, with a broadcast hint if it is small."""
    return hinted(cut_lineage(table))
