"""Small helpers that run inside Python tasks."""

import ctypes
import pickle
import sys
from collections.abc import Callable, Iterator
from contextlib import suppress
from types import ModuleType

import pyarrow as pa
from pyspark import cloudpickle


def _give_back() -> None:
    """A worker goes on, or waits for its next task, with all memory it ever had, unless it gives back what is free."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def kept(key: str, make: Callable):
    """What a worker makes once and uses in all its tasks, such as a tokenizer.

    The library travels to the workers by value, so its globals last for one
    task; this lives in the worker's table of modules and so for all of them.
    Only the last thing asked for is kept: a worker that goes on to another
    operator lets go of the memory of the one before.
    """
    state = sys.modules.setdefault("quillmark_worker_state", ModuleType("quillmark_worker_state"))
    if getattr(state, "key", None) != key:
        state.key = state.value = None
        _give_back()
        state.value = make()
        state.key = key
    return state.value


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that long texts never meet in large numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    _give_back()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column; null is empty."""
    return [text or "" for text in batch.column(name).to_pylist()]


def share(spark, value) -> Callable:
    """A function that gives the value in any task, sent to each executor once.

    The value travels by value like the functions do, so a worker can read it
    without having the library.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)
