import random
from collections import Counter, defaultdict

import pytest

from parcelflow.llm import packing as P


def piecewise(lengths: list[int], capacity: int) -> list[int]:
    """Best-fit decreasing, one piece at a time: the bins' fills."""
    fills: list[int] = []
    for x in sorted(lengths, reverse=True):
        fit = [(f, -k) for k, f in enumerate(fills) if f + x <= capacity]
        if fit:
            fills[-max(fit)[1]] += x
        else:
            fills.append(x)
    return fills


def filled(runs):
    at = defaultdict(list)
    ranks = defaultdict(list)
    for length, first, n, b, off in runs:
        for i in range(n):
            at[b + i].append((off, length))
            ranks[length].append(first + i)
    return at, ranks


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    cap = r.choice([7, 16, 50])
    hist = Counter(r.randrange(1, cap + 1) for _ in range(r.randrange(0, 120)))
    runs = P.plan(hist, cap)
    at, ranks = filled(runs)
    assert {x: sorted(v) for x, v in ranks.items()} == {x: list(range(n)) for x, n in hist.items()}
    assert sorted(at) == list(range(len(at)))
    for slots in at.values():  # no gaps, no overlaps
        end = 0
        for off, length in sorted(slots):
            assert off == end
            end += length
        assert end <= cap
    assert sorted(sum(n for _, n in s) for s in at.values()) == sorted(piecewise(list(hist.elements()), cap))


def test_plan_size_does_not_follow_the_counts():
    small = P.plan({x: 10 for x in range(1, 64)}, 64)
    assert len(P.plan({x: 10_000_000 for x in range(1, 64)}, 64)) <= 2 * len(small)


def test_too_long_a_piece():
    with pytest.raises(ValueError):
        P.plan({9: 1}, 8)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_every_piece_has_one_slot(spark, odd, limit, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_ROWS", limit)
    got = P.pack(odd, 256, 40).collect()
    want = sum(-(-(len((r["text"] or "").split()) + 1) // 256) for r in odd.collect())
    assert len(got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["bin_id"]].append((r["bin_offset"], r["length"]))
    for s in slots.values():
        end = 0
        for off, n in sorted(s):
            assert off == end
            end += n
        assert end <= 256
    assert sorted(slots) == list(range(len(slots)))


def test_empty(spark, empty):
    assert P.pack(empty).count() == 0
