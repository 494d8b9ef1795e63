"""Files are written from the memory of Arrow's batches."""

import tracemalloc

import pyarrow as pa

from bindery.sinks.files import _writer


def test_contents_are_not_copied(tmp_path):
    size, n = 1 << 20, 48
    contents = [bytes([i]) * size for i in range(n)] + [b"", None]
    paths = [f"d/{i}" for i in range(len(contents))]
    batch = pa.record_batch(
        {"bundle": ["b"] * len(paths), "path": paths, "content": pa.array(contents, pa.binary())}
    )
    tracemalloc.start()
    told = [b.to_pydict() for b in _writer(str(tmp_path))(iter([batch, batch.slice(0, 0)]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told[0]["path"] == paths and told[1]["path"] == []
    assert told[0]["status"] == ["WRITTEN"] * (n + 1) + ["FAILED"]
    assert all((tmp_path / "b" / p).read_bytes() == c for p, c in zip(paths, contents) if c is not None)
    assert peak < 8 * size  # pandas had them all
