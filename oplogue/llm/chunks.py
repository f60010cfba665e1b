"""A bounded table of distinct chunks and what a tokenizer makes of each."""

from __future__ import annotations


class ChunkTable(dict):
    """chunk -> encoding, each worked out once. Two generations bound it: at ``size`` chunks the young become the old,
    and old chunks that are met again move back."""

    def __init__(self, encode, size: int = 250_000):
        super().__init__()
        self.encode, self.size, self.old = encode, size, {}

    def __missing__(self, chunk):
        found = self.old.get(chunk)
        if found is None:
            found = self.encode(chunk)
        self.put(chunk, found)
        return found

    def put(self, chunk, found) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[chunk] = found

    def unknown(self, chunks) -> list:
        return [c for c in chunks if c not in self and c not in self.old]


def grouped(sizes, limit: int):
    """Places [start, end) of runs of texts of about ``limit`` together."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    yield start, len(sizes)


#: Tables live as long as the Python worker, which Spark reuses for many tasks.
_kept: dict = {}


def kept(key, make):
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def latest(key, tag, make):
    """Like :func:`kept`, but one value a key: another ``tag`` replaces it."""
    if _kept.get(key, (None, None))[0] != tag:
        _kept.pop(key, None)
        _kept[key] = tag, make()
    return _kept[key][1]


def tidy(run):
    """``run`` (batches -> batches) after which the worker gives back the memory that Arrow keeps for later; workers wait
    for other tasks for long."""

    def whole(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return whole
