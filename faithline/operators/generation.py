"""Completions by a model. Models are the caller's; here is how they are run, and stubs that need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

#: Makes, once in a task, what turns a list of prompts into a list of completions.
Generator = Callable[[], Callable[[list[str]], list[str]]]


def echo() -> Callable[[list[str]], list[str]]:
    """A stub that says its prompt's last part."""
    return lambda prompts: [p.rpartition("\n\n")[2] for p in prompts]


def mock() -> Callable[[list[str]], list[str]]:
    """A stub that says that it is one."""
    return lambda prompts: [f"mock completion for {p[:10]}" for p in prompts]


def generated(df: DataFrame, prompt: str, generator: Generator, batch_size: int = 16, out: str = "completion") -> DataFrame:
    """df with the completion of each prompt (null for null), by batches of ``batch_size`` prompts. A completion belongs to its row, so
    nothing is matched by position afterwards; a lost task runs its batches again."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([*df.schema.fields, StructField(out, StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = generator()
        for b in batches:
            for lo in range(0, b.num_rows, batch_size):
                part = b.slice(lo, batch_size)
                asked = part.column(prompt).to_pylist()
                said = iter(model([p for p in asked if p is not None]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if p is None else next(said) for p in asked], pa.string())], schema=arrow)

    return df.mapInArrow(run, schema)
