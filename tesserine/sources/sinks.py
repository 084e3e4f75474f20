"""Sinks and actions: text files, pretty printing, timing."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, line: F.Column | str = "value", append: bool = False) -> None:
    """One text file for each partition; overwrites unless append."""
    df.select((F.col(line) if isinstance(line, str) else line).cast("string").alias("value")).write.mode("append" if append else "overwrite").text(path)


def write_lines_sequential(df: DataFrame, path: str, line: F.Column | str = "value", append: bool = False) -> None:
    """A single text file."""
    write_lines(df.coalesce(1), path, line, append)


def table_text(df: DataFrame, max_rows: int = 100) -> str:
    """The first rows in a box, under the columns' names; a table without rows is its names and a note."""
    rows = [["" if x is None else str(x) for x in r] for r in df.limit(max_rows + 1).collect()]
    if not rows:
        return f"{' | '.join(df.columns)}\n(no rows)"
    more = len(rows) > max_rows
    grid = [df.columns, *rows[:max_rows]]
    width = [max(len(r[i]) for r in grid) for i in range(len(df.columns))]
    rule = "=" * (sum(width) + 3 * len(width) + 1)
    body = ["| " + " | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)) + " |" for r in grid]
    return "\n".join([rule, body[0], rule, *body[1:], rule, *(["..."] if more else [])])


def print_as_table(df: DataFrame, max_rows: int = 100) -> None:
    print(table_text(df, max_rows))


@contextmanager
def timed(name: str, sink: dict[str, float], *frames: DataFrame) -> Iterator[None]:
    """Times the block; tables given are computed before the clock starts, so that only the block's own work counts."""
    for df in frames:
        df.write.format("noop").mode("overwrite").save()
    start = time.perf_counter()
    yield
    sink[name] = time.perf_counter() - start


def materialise(df: DataFrame) -> None:
    """Computes every row and keeps none."""
    df.write.format("noop").mode("overwrite").save()
