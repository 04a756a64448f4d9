"""What the operators' Python workers share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


#: How to empty the large caches of this worker, by the module that filled them.
CACHES: dict[str, Callable[[], None]] = {}


def forget_others(*kept: str) -> None:
    """Empty the caches that earlier stages left in this worker; those of the modules named stay."""
    for name in [n for n in CACHES if n not in kept]:
        CACHES.pop(name)()


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and an executor's memory counts them all."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def by_key(of_task: Callable[[pa.Table], pa.RecordBatch]):
    """mapInArrow function over rows sorted by ``key``: ``of_task`` of each key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index("key"))
            new = np.flatnonzero(np.array(pc.not_equal(keys[1:], keys[:-1]), bool)) + 1
            if held and held[0].column("key")[0] != keys[0]:
                yield of_task(pa.Table.from_batches(held))
                held = []
            cuts = [0, *new.tolist()]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                yield of_task(pa.Table.from_batches([*held, batch.slice(lo, hi - lo)]))
                held = []
            held.append(batch.slice(cuts[-1]))
        if held:
            yield of_task(pa.Table.from_batches(held))
        give_back()

    return run
