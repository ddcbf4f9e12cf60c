"""Files that a program of its own reads: PDF pages by a parser, OCR answers by a service with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Tries and the first wait in seconds.
ATTEMPTS, BACKOFF = 3, 5


def waits(attempts: int = ATTEMPTS, base: float = BACKOFF) -> list[float]:
    """Seconds before each further try."""
    return [base * 2**i for i in range(attempts - 1)]


def with_retries(call: Callable[[], str], attempts: int = ATTEMPTS, base: float = BACKOFF, lost: tuple = (TimeoutError, ConnectionError), sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer of a service; only what it loses on the way is tried again."""
    pause = waits(attempts, base)
    for n in range(attempts):
        try:
            return call()
        except lost as e:
            if n + 1 == attempts:
                raise RuntimeError(f"failed after {attempts} attempts: {e}") from e
            sleep(pause[n])
    raise AssertionError


def ocr_answers(files: DataFrame, call: Callable[[str, bytes], str], attempts: int = ATTEMPTS, base: float = BACKOFF) -> DataFrame:
    """file_name, answer, error for every file (file_name, content); a file that fails is a row of its own and fails no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                answer = error = None
                try:
                    answer = with_retries(lambda name=name, content=content: call(name, content), attempts, base)
                except Exception as e:  # one file's error is its row's
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([answer], pa.string()), pa.array([error], pa.string())], names=["file_name", "answer", "error"])

    return files.select("file_name", "content").mapInArrow(run, "file_name string, answer string, error string")


def parsed_pages(files: DataFrame, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """file_name, page (from 1), text, error of every page that a parser finds in (file_name, content).

    Blank pages are rows too; a file that fails is one row with its error and fails no other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pages = parse(content)
                    made = [[name] * len(pages), list(range(1, len(pages) + 1)), pages, [None] * len(pages)]
                except Exception as e:  # one file's error is its row's
                    made = [[name], [None], [None], [f"{type(e).__name__}: {e}"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["file_name", "page", "text", "error"])

    return files.select("file_name", "content").mapInArrow(run, "file_name string, page int, text string, error string")
