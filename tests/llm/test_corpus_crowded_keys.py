"""Windows of a crowded key: what is looked at grows with the windows, and how many are looked at first changes nothing."""

import numpy as np
import pyarrow as pa
import pytest

from tabloom.llm import passages

_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def crowd(n, seed, copies=1.0, length=120):
    """Windows of one key, near copies of six texts or parts of them."""
    rng = np.random.default_rng(seed)
    texts = rng.integers(0, 1 << 31, (6, length)).astype(np.int32)
    rows = []
    for i in range(n):
        text, own = texts[rng.integers(6)], rng.integers(0, 1 << 31, length).astype(np.int32)
        if rng.random() < copies:
            own = np.where(rng.random(length) < 0.03, own, text)
        else:
            a = rng.integers(0, length - 40)
            own[a : a + 70] = text[a : a + 70]
        left = int(rng.integers(0, 50))
        known = [{"first": left, "last": left + int(rng.integers(40, length))}] if rng.random() < 0.3 else None
        rows.append((1, i // 2, left, left + length - 1, bool(rng.random() < 0.9), own.tolist(), known))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), _SPANS)
    names = ["key", "id", "left", "right", "seeks", "shingles", "spans"]
    rows.sort(key=lambda r: r[:3])
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)


def settled(batch):
    return pa.Table.from_batches(passages._settled(iter([batch]))).to_pylist()


def test_looks_grow_with_the_windows(monkeypatch):
    seen, runs = [], passages._long_runs
    monkeypatch.setattr(passages, "_long_runs", lambda at, owner: seen.append(len(at)) or runs(at, owner))
    looks = {}
    for n in (200, 1_600):
        seen.clear()
        assert len(settled(crowd(n, 1))) > n // 2
        looks[n] = sum(seen)
    assert looks[1_600] < 2 * 8 * looks[200]


@pytest.mark.parametrize("copies", [0.2, 0.8])
def test_first_look_changes_nothing(monkeypatch, copies):
    batch = crowd(150, 2, copies)
    found = []
    for first, gathered in ((1 << 20, 1 << 20), (64, 1 << 20), (1, 1 << 20), (7, 500)):
        monkeypatch.setattr(passages, "_FIRST_LOOK", first, raising=False)
        monkeypatch.setattr(passages, "_GATHERED", gathered)
        found.append(settled(batch))
    assert len(found[0]) > 50 and all(f == found[0] for f in found)
