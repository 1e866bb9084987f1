import pytest
from hypothesis import given
from hypothesis import strategies as st

from suffixspark.functions.cover import COVERS, Cover


@pytest.mark.parametrize("x", COVERS)
def test_covers_are_valid(x):
    assert Cover.of(x).valid


def test_unknown_modulus():
    with pytest.raises(ValueError):
        Cover.of(5)


@given(st.sampled_from(sorted(COVERS)), st.integers(0, 500))
def test_counts_slots_and_way_back(x, n):
    c = Cover.of(x)
    assert c.positions_per_residue(n) == tuple(len(range(r, n, x)) for r in range(x))
    samples = [p for p in range(n + c.needs_dummy(n)) if c.contains(p)]
    assert [c.slot(p) for p in samples] == list(range(len(samples)))
    order = sorted(samples, key=lambda p: (p % x, p // x))
    starts = c.starts(n)
    assert [starts[p % x] + p // x for p in order] == list(range(len(order)))
    assert [c.back(i, n) for i in range(len(order))] == order


@pytest.mark.parametrize("x", [3, 7, 13, 39])
def test_depths(x):
    c = Cover.of(x)
    for a in range(x):
        for b in range(x):
            d = c.depth[a][b]
            assert d < x and c.contains(a + d) and c.contains(b + d)
            assert c.turn[a * x + b] == len([k for k in range(d) if c.contains(a + k)])
