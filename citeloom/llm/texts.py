"""Arrow batches of texts as byte arrays of bounded size."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; one longer text is a slice of its own.
SLICE = 2 << 20


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of ``column`` with about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > limit:
            yield start, row - start
            start, held = row, 0
        held += size + 1
    if len(sizes) > start:
        yield start, len(sizes) - start


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each ended by a line feed, as uint8; and where each starts, with the end."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return data, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edges = np.diff(np.concatenate([np.zeros(1, np.int8), flags.view(np.int8), np.zeros(1, np.int8)]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def bodies(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of the texts; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
