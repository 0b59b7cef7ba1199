"""Passes over a table's texts, in Arrow batches: a text is the unit of work, and no shuffle is needed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .lines import Rewrite

#: What a task holds at once beside Spark's batch: texts of the input, and characters and rows of the output.
TEXTS, CHARS, ROWS = 16, 1 << 20, 5000


def rows_of(docs: DataFrame, of: Callable[..., list[tuple]], schema: str, *columns: str, key: str = "doc_id") -> DataFrame:
    """(key, *schema): the rows that ``of`` gives for the ``columns`` of each row; rows with a null give none."""
    kind = docs.select(key).schema.fields[0].dataType.simpleString()
    made = StructType.fromDDL(f"{key} {kind}, {schema}")
    types = to_arrow_schema(made)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for f, c in zip(types, zip(*rows, strict=True), strict=True)], names=types.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            held = 0
            for at in range(0, b.num_rows, TEXTS):  # a batch of Spark's has ten thousand texts
                for k, *given in zip(*(c.to_pylist() for c in b.slice(at, TEXTS).columns), strict=True):
                    if any(x is None for x in given):
                        continue
                    for row in of(*given):
                        out.append((k, *row))
                        held += sum(len(x) for x in row if isinstance(x, (str, bytes)))
                        if held > CHARS or len(out) >= ROWS:
                            yield batch(out)
                            out, held = [], 0
            if out:
                yield batch(out)

    return docs.select(key, *columns).mapInArrow(run, made)


def rewritten(docs: DataFrame, *passes: Callable[[list[str]], Rewrite], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text, moved): each text after the passes, and how many of its lines now stand elsewhere."""

    def of(source: str) -> list[tuple]:
        out = Rewrite(source.split("\n"), list(range(source.count("\n") + 1)))
        for step in passes:
            out = out.then(step(out.lines))
        return [("\n".join(out.lines), sum(i != w for i, w in enumerate(out.where)))]

    return rows_of(docs, of, "text string, moved int", text, key=key)


def mapped(docs: DataFrame, *passes: Callable[[list[str]], Rewrite], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, old_line, new_line) of each line under the passes, one after another."""

    def of(source: str) -> list[tuple]:
        out = Rewrite(source.split("\n"), list(range(source.count("\n") + 1)))
        for step in passes:
            out = out.then(step(out.lines))
        return list(enumerate(out.where))

    return rows_of(docs, of, "old_line int, new_line int", text, key=key)
