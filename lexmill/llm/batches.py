"""Small helpers for the Arrow batches that Python tasks receive."""

import ctypes

import numpy as np
import pyarrow as pa

_held: dict = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def give_back() -> None:
    """Return to the system what Arrow and the C library keep of memory that is no longer used."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def held(key, make):
    """What make() gives for the key, kept per worker process between tasks until another key is asked for.

    Workers outlive a stage, so what each operator keeps would add up over the stages of a pipeline.
    """
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


def slices(batches, rows: int = 256):
    """Record batches cut to at most `rows` rows, so that few texts are Python objects at a time. The parts are copies, so
    none holds its batch while the next one is read; what is kept of memory that is done with goes back at the end, as
    the worker waits for other tasks with it."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch if batch.num_rows <= rows else batch.take(np.arange(at, min(at + rows, batch.num_rows)))
        batch = None
    give_back()


def sorted_groups(batches, keys: list[str], columns: list[str], to_numpy):
    """Yield (rows, starts) of whole groups from batches that are sorted by `keys`.

    rows is a dict of numpy arrays and starts the offsets at which a new key begins. A group that goes on in the
    next batch is carried over whole, so groups must be of bounded size.
    """
    rest = None
    for batch in batches:
        now = {c: to_numpy(c, batch.column(c)) for c in [*keys, *columns]}
        if rest is not None:
            now = {c: np.concatenate([rest[c], now[c]]) for c in now}
        n = len(now[keys[0]])
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = np.logical_or.reduce([now[k][1:] != now[k][:-1] for k in keys])
        starts = np.flatnonzero(new)
        last = starts[-1]
        rest = {c: v[last:] for c, v in now.items()}
        if last:
            yield {c: v[:last] for c, v in now.items()}, starts[:-1]
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def forest(adjacent: np.ndarray) -> np.ndarray:
    """For a boolean adjacency matrix the lowest index of each row's component."""
    n = len(adjacent)
    label = np.full(n, -1)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        edge = np.array([seed])
        while len(edge):
            edge = np.flatnonzero(adjacent[edge].any(axis=0) & (label < 0))
            label[edge] = seed
    return label
