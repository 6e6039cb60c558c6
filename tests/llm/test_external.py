"""The suffix sort of a shard that is several times larger than what the sort may hold."""

import tracemalloc

import numpy as np

from textquarry.llm import induced, repeats

WIDTH = 50


def lots(n, seed=1):
    """Lots of (bytes, counts, ids) of segments; half of them stand in several lots, some share windows with others."""
    r = np.random.default_rng(seed)
    pool = [r.integers(97, 123, WIDTH + int(c) - 1).astype(np.uint8).tobytes() for c in r.integers(1, 33, max(2, n // 4))]
    hot = r.integers(97, 123, WIDTH + 3).astype(np.uint8).tobytes()
    out, rows = [], []
    for lot in range(0, n, 500):
        segments = []
        for i in range(lot, min(n, lot + 500)):
            kind = r.integers(0, 4)
            own = pool[int(r.integers(0, len(pool)))] if kind < 2 else hot + r.integers(97, 123, int(r.integers(0, 20))).astype(np.uint8).tobytes() if kind == 2 else r.integers(97, 123, WIDTH + int(r.integers(0, 32))).astype(np.uint8).tobytes()
            segments.append((own, int(r.integers(0, 1000))))
        out.append((b"".join(s for s, _ in segments), np.array([len(s) - WIDTH + 1 for s, _ in segments], np.uint8).tobytes(), np.array([i for _, i in segments], np.int64).tobytes()))
        rows.append(segments)
    return out, rows


def masks(folder, given, budget):
    shard = repeats.Shard(folder, WIDTH, budget)
    for lot in given:
        shard.add(*lot)
    return list(shard.masks())


def test_masks_of_a_shard(tmp_path, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 64)
    monkeypatch.setattr(induced, "BLOCK", 256)
    given, rows = lots(3000)
    least = {}
    for segments in rows:
        for s, i in segments:
            for a in range(len(s) - WIDTH + 1):
                w = s[a : a + WIDTH]
                least[w] = min(i, least.get(w, i))
    for k, (blob, segments) in enumerate(zip(masks(str(tmp_path), given, 500), rows)):
        got = np.frombuffer(blob, np.uint32) if blob else np.zeros(len(segments), np.uint32)
        for bits, (s, i) in zip(got.tolist(), segments):
            for a in range(len(s) - WIDTH + 1):
                assert bool(bits >> a & 1) == (least[s[a : a + WIDTH]] < i), (k, a)


def test_memory_does_not_follow_the_shard(tmp_path, monkeypatch):
    """Four times the shard takes no more memory, and less than the smaller one's bytes with its queue entries."""
    monkeypatch.setattr(induced, "BLOCK", 1 << 13)
    monkeypatch.setattr(repeats, "CHUNK", 1 << 11)
    peaks, sizes = [], []
    for k, n in enumerate((20_000, 80_000)):
        given, _ = lots(n, k)
        (tmp_path / str(k)).mkdir()
        shard = repeats.Shard(str(tmp_path / str(k)), WIDTH, 1 << 14)
        for lot in given:
            shard.add(*lot)
        sizes.append(sum(len(lot[0]) + 10 * len(lot[0]) + 9 * len(lot[1]) for lot in given))  # bytes, entries, counts and ids
        del given
        tracemalloc.start()
        for _ in shard.masks():
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] and 6 * peaks[1] < sizes[1], (peaks, sizes)
