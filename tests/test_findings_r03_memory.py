"""Memory of the language model's tasks."""
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd

from harrow.llm import pitmanyor as py


def _parts(chunks=4, words=8_000, run=25):
    """Keys of one shard in ``chunks`` chunks, each of ``words`` words in ``run`` contexts, none of them frequent."""
    rng = np.random.default_rng(5)
    pool, contexts = (np.unique(rng.integers(1, 1 << 52, n, np.uint64)) for n in (2 * words, 60_000))
    parts = []
    for chunk in range(chunks):
        n = words * run
        parts.append({
            "chunk": chunk, "words": py.pack_keys(np.sort(rng.choice(pool, words, replace=False))), "runs": py.squeeze(np.full(words, run, "<u4")),
            "codes": py.squeeze(np.full(n, py.FREQUENT, "<u4")), "others": rng.choice(contexts, n).astype("<u8").tobytes(),
            "counts": py.squeeze(rng.integers(0, 9, n).astype("<u4"))})
    return parts, chunks * words * run


def test_a_pass_takes_few_bytes_a_key():
    parts, keys = _parts()
    known = SimpleNamespace(value=py.Frequent(np.empty(0, np.uint64)))
    batch = pd.DataFrame({"shard": [3], "x": [parts], "replies": [None]})
    assert len(list(py._sweep(known, SimpleNamespace(value=[]), 3)([batch]))) == 2
    tracemalloc.start()
    for out in py._sweep(known, SimpleNamespace(value=[]), 3)([batch]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 105 * keys


def test_distinct_is_unique():
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 50, 1000), rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2), np.empty(0, np.int64), np.array([7, 7])):
        values, place = py.distinct(x)
        want, inverse = np.unique(x, return_inverse=True)
        assert values.dtype == x.dtype and values.tolist() == want.tolist() and place.tolist() == inverse.tolist()
