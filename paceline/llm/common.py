"""What the operators of this package share: intermediate tables, row order, and words of a batch of texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.session import shared_folder

#: Bytes of text that a task turns into arrays at a time.
CHUNK_BYTES = 8_000_000


def work_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, inside the shared checkpoint folder."""
    return f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    It cuts the lineage: a lost executor costs only the tasks it ran, never the steps before the table. The
    tables stay until `cleanup`, as results that were not yet read may depend on them.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call it when its results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def crc32_of_id(id_col: str) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Texts of at most `rows` labelled documents: those with the smallest hashed ids. Columns: doc_id, text, label.

    Only the ids drawn travel to the texts; their number is the bound, so they may be broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    drawn = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return texts.join(F.broadcast(drawn), "doc_id")


def chunks(batches: Iterator[pa.RecordBatch], column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `limit` bytes of the text in `column`, and at least one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(column: pa.Array) -> pa.Array:
    """The texts with 64-bit offsets, null as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def spaced_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Cut each text before every space: document offsets, a code per part, and the distinct parts.

    A part holds at most one space, its first character, so the parts of a text put together are the text.
    """
    lists = pc.split_pattern(texts, " ")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    words = lists.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = words.dictionary.to_pylist()
    # The first part of a text has no space before it: it gets a code of its own.
    first = np.zeros(len(codes), dtype=bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    codes = codes * 2 + first
    used, codes = np.unique(codes, return_inverse=True)
    parts = [distinct[c >> 1] if c & 1 else " " + distinct[c >> 1] for c in used.tolist()]
    return offsets, codes, parts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
