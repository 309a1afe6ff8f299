"""Batches become Python objects a slice at a time, whatever the size of their values."""

import pyarrow as pa

from compactcodec.functions import codec


def test_slices_are_bounded_and_whole():
    rows = pa.array([[{"a": i, "b": "x" * 1000}] * (i % 7 * 200) for i in range(40)] + [None, []])
    sizes = []

    def one(part):
        sizes.append((len(part), part.nbytes))
        return part.to_pylist()

    assert codec._sliced(rows, rows.type, one).equals(rows)
    assert len(sizes) > 5 and all(n == 1 or size <= codec.SLICE for n, size in sizes)
    assert codec._sliced(pa.chunked_array([rows, rows]), rows.type, one).to_pylist() == rows.to_pylist() * 2
    assert codec._sliced(rows.slice(0, 0), pa.string(), one).equals(pa.array([], pa.string()))
