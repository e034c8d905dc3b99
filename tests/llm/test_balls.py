"""Large groups of near copies: link counts equal brute force, and a set stands in few rows."""

import random

import numpy as np
import pytest

from pulsegrid.llm import jaccard


def group(changes, words=150, seed=3):
    """A text for each number of changed words."""
    r, texts = random.Random(seed), []
    for copy, many in enumerate(changes):
        some = [f"w{i}" for i in range(words)]
        for at in r.sample(range(words), many):
            some[at] = f"c{copy}x{at}"
        texts.append(" ".join(some))
    return texts


def links_of(texts):
    """Other texts at 0.8 or above, and the least number reached by links."""
    number: dict[tuple, int] = {}
    sets = [{number.setdefault(tuple(w[i : i + 5]), len(number)) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    member = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        member[i, list(s)] = 1
    shared, n = (member @ member.T).astype(np.int64), member.sum(1).astype(np.int64)
    near = 5 * shared >= 4 * (n[:, None] + n - shared)
    least = np.arange(len(sets))
    while not np.array_equal(least, low := np.where(near, least, len(sets)).min(axis=1)):
        least = low
    return [(i, int(c), int(f)) for i, (c, f) in enumerate(zip(near.sum(1) - 1, least, strict=True))]


def found(docs):
    return sorted((r.id, r.n_links, r.class_id) for r in jaccard.near_duplicates(docs).collect())


@pytest.fixture
def compared_rows(monkeypatch):
    """Rows that go into the comparison by coordinates."""
    rows, mapped = [], jaccard.mapped

    def counted(df, kernel, schema):
        if kernel is jaccard._compared:
            rows.append(df.count())
        return mapped(df, kernel, schema)

    monkeypatch.setattr(jaccard, "mapped", counted)
    return rows


@pytest.mark.parametrize("block", [None, 100])
def test_cores_bands_and_shells_equal_brute_force(make, monkeypatch, compared_rows, block):
    if block:
        monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(8)
    texts = group([r.choice((0, 1, 1, 1, 2, 2, 3, 4, 5, 6, 8)) for _ in range(1200)])
    texts += [t.replace("w7 ", "other ") for t in texts[:40]] + texts[40:60]  # links of changed words, and copies
    assert found(make(list(enumerate(texts)))) == links_of(texts)
    if not block:
        assert sum(compared_rows) < 6 * len(texts)


@pytest.mark.parametrize("copies", [800, 3000])
def test_a_core_gives_no_pairs(make, compared_rows, copies):
    texts = group([1] * copies, words=120)
    far = group([3] * 20, words=120, seed=4)
    texts += [t.replace(" c", " d") for t in far]  # some 0.8 from the core
    want = links_of(texts)
    assert found(make(list(enumerate(texts)))) == want and any(0 < n < copies - 1 for _, n, _ in want[copies:])
    assert sum(compared_rows) < 3 * len(texts)


def test_overlapping_balls_count_each_pair_once(make, monkeypatch):
    """Two groups 0.2 to 0.4 apart: sets of one stand in the shell of the other, and each pair is counted by one owner."""
    for name, value in (("SPLIT_OVER", 60), ("BLOCK", 50), ("DENSE", 6)):
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(2)
    some = [r.choice((0, 1, 1, 2, 3)) for _ in range(300)]
    texts = group(some)
    for words, seed in ((2, 5), (4, 6)):
        moved = group(some, seed=seed)
        for i in range(words):
            moved = [t.replace(f" w{30 * i + 11} ", f" v{30 * i + 11} ") for t in moved]
        texts += [t.replace(" c", f" e{seed}") for t in moved]
    assert found(make(list(enumerate(texts)))) == links_of(texts)
