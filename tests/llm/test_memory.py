"""What a worker holds while it hashes the words of a block, and what it gives out of a bucket."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from thermaline.llm import common, op10_jaccard_join


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, data[:-1] == 32))
    return starts, np.append(starts[1:], len(data))


def test_hashes_of_words_don_t_depend_on_their_place():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 3 * common._PIECE + 5).astype(np.uint8)
    data[rng.integers(0, len(data), 90_000)] = 32
    data[common._PIECE - 20 : 2 * common._PIECE + 20] = 97  # a word longer than a piece
    starts, ends = words(data)
    starts, ends = np.append(starts, len(data)), np.append(ends, len(data))  # and an empty one at the end
    got = common.word_hashes(data, starts, ends)
    some = rng.integers(0, len(starts), 500).tolist() + [len(starts) - 1, int(np.argmax(ends - starts))]
    assert all(common.word_hashes(data[starts[k] : ends[k]], np.array([0]), np.array([ends[k] - starts[k]]))[0] == got[k] for k in some)
    assert (common.word_hashes(data, starts[::-1], ends[::-1]) == got[::-1]).all()


def test_a_block_s_hashes_need_little_memory():
    data = np.tile(np.frombuffer(b"some words ", np.uint8), 400_000)
    starts, ends = words(data)
    common._powers[:] = [np.ones(1, np.uint64)] * 2
    tracemalloc.start()
    common.word_hashes(data, starts, ends)
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 24 << 20 and most < 48 << 20


@pytest.mark.parametrize("k", [48, 0])
def test_a_bucket_gives_each_pair_once(k):
    # 200 sketches of 64 words take two turns.
    rng, n = np.random.default_rng(3), 200
    names = [bytes([i]) for i in rng.permutation(n).tolist()]
    sketches = [rng.integers(0, 1 << 63, 64, np.uint64).tobytes() for _ in names]
    rows = pa.RecordBatch.from_pydict({"sig": [1] * n, "block": [0] * n, "side": [0] * n, "node": names, "first": list(range(n)), "label": names, "n": [20_000] * n, "sketch": sketches})
    got = [(r["u"], r["v"]) for b in op10_jaccard_join._name(80, k)([rows]) for r in b.to_pylist() if r["u"] is not None]
    bucket = op10_jaccard_join.Bucket([20_000] * n, names, sketches, [0] * n, 80)
    want = {tuple(sorted((names[x], names[y]))) for i, j, _ in bucket.nearest(k) for x, y in zip(i.tolist(), j.tolist(), strict=True)}
    assert len(got) == len(set(got)) and set(got) == want and all(u < v for u, v in got)
