"""Arrow-batch tasks: what the operators' Python parts share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# A batch that reaches Python is worked on in slices of about so many characters.
SLICE_CHARS = 1_000_000


def slices(columns: list[pa.Array], text_at: int) -> Iterator[list[list]]:
    """Cut the Python lists of a batch where its texts exceed ``SLICE_CHARS``; a single long text stays whole."""
    texts = columns[text_at]
    sizes = [n or 0 for n in pc.binary_length(texts).to_pylist()]
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > SLICE_CHARS:
            yield [c.slice(start, i - start).to_pylist() for c in columns]
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield [c.slice(start).to_pylist() for c in columns]


def map_texts(df: DataFrame, schema: str, work: Callable[..., dict[str, list]]) -> DataFrame:
    """Apply ``work(*columns) -> {name: values}`` to slices of rows; the text is the last column of ``df``.

    Rows stay where they are: no shuffle. ``work`` gets one list per column
    and returns as many rows as it likes.
    """
    types = df.sparkSession.createDataFrame([], schema).schema
    fields = to_arrow_schema(types)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in slices(batch.columns, len(batch.columns) - 1):
                out = work(*columns)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, types)


def filter_texts(docs: DataFrame, decide: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of ``docs`` whose ``text`` is kept by ``decide``, all columns as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [k for (texts,) in slices([batch["text"]], 0) for k in decide(texts)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def rewrite_texts(docs: DataFrame, rewrite: Callable[[list[str | None]], list[str | None]]) -> DataFrame:
    """``docs`` with each ``text`` rewritten, all other columns as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for (texts,) in slices([batch["text"]], 0) for t in rewrite(texts)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def documents(spark, sf_dir: str, *columns: str) -> DataFrame:
    """``doc_id``, the further columns, and the text last, of the documents table."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(F.col("doc_id").cast("long"), *columns, F.col("text").cast("string"))
