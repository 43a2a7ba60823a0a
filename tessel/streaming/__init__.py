"""Programs over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..api import Program


def run_stream(program: Program, stream: DataFrame, *, keys: list[str] | None = None, json: str | None = None) -> DataFrame:
    """Outputs of a program for every row of a streaming DataFrame.

    Programs work row by row, so they keep no state, need no watermark and run in
    append mode on any source; windows and aggregates can follow on the result.
    """
    if not stream.isStreaming:
        raise ValueError("this is not a streaming DataFrame")
    return program.run(stream, keys=keys, json=json)
