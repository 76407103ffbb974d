"""What a task holds beside its rows does not grow with the passages times the items."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tabloom.llm import decontaminate


def test_search_for_items_is_bounded(monkeypatch):
    rng = np.random.default_rng(7)
    items = decontaminate._items(
        pa.table(
            {
                "question": [" ".join(f"w{x}" for x in rng.zipf(1.3, 30) % 500) for _ in range(2_000)],
                "answer": [f"answer{i} word" for i in range(2_000)],
            }
        )
    )
    index = decontaminate.BlockMaxIndex(items)
    n_terms, n_queries = len(index.vocabulary), 1_000
    held = [np.unique(np.concatenate([rng.integers(0, n_terms, 30), index.lookup(index.items[i].terms)[1]])) for i in range(n_queries)]
    query, term = np.repeat(np.arange(n_queries), [len(x) for x in held]), np.concatenate(held)
    monkeypatch.setattr(decontaminate, "_CELLS", 1 << 60, raising=False)
    whole = index.open_blocks(query, term, n_queries)
    monkeypatch.undo()
    tracemalloc.start()
    hit, block = index.open_blocks(query, term, n_queries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hit) >= n_queries and np.array_equal(hit, whole[0]) and np.array_equal(block, whole[1])
    assert peak < 40 << 20
    none = np.zeros(0, np.int64)
    assert [len(x) for x in index.open_blocks(none, none, 0)] == [0, 0]
