import math

import pytest

from draftlake.functions import geometry as g


def ends(d, **kw):
    return [(s.type, s.end) for s in g.path_segments(d, **kw)]


@pytest.mark.parametrize(
    ("d", "want"),
    [
        ("M0 0 L3 4", [("line", (3, 4))]),
        ("m1 1 l3 4", [("line", (4, 5))]),
        ("M0 0 5 0 5 5", [("line", (5, 0)), ("line", (5, 5))]),
        ("M0 0 H4 V3 h-4 v-3", [("line", (4, 0)), ("line", (4, 3)), ("line", (0, 3)), ("line", (0, 0))]),
        ("M0 0 C1 1 2 2 3 3 c1 1 2 2 3 3", [("curve", (3, 3)), ("curve", (6, 6))]),
        ("M0 0 Q1 1 2 0 q1 1 2 0", [("curve", (2, 0)), ("curve", (4, 0))]),
        ("M0 0 S1 1 2 0 s1 1 2 0", [("curve", (2, 0)), ("curve", (4, 0))]),
        ("M0 0 T2 0 4 0 t1 1", [("curve", (2, 0)), ("curve", (4, 0)), ("curve", (5, 1))]),
        ("M0 0 A1 1 0 0 1 2 0 a1 1 0 0 1 2 0", [("arc", (2, 0)), ("arc", (4, 0))]),
        ("M0 0 L1 0 L1 1 Z", [("line", (1, 0)), ("line", (1, 1)), ("close", (0, 0))]),
        ("M0 0 L1 0 L0 0 z", [("line", (1, 0)), ("line", (0, 0))]),
        ("M1e1-5 L.5,1.5", [("line", (0.5, 1.5))]),
        ("", []),
    ],
)
def test_commands(d, want):
    assert ends(d) == want


def test_relative_moves_draw_their_further_pairs_unless_compat():
    assert ends("m1 1 2 0") == [("line", (3, 1))]
    assert ends("m1 1 2 0", compat=True) == []


def test_smooth_quadratics_in_compat_take_four_numbers():
    assert ends("M0 0 T2 0 4 0", compat=True) == [("curve", (4, 0))]
    with pytest.raises(ValueError):
        g.path_segments("M0 0 T2 0", compat=True)


def test_arc_length():
    assert g.arc_length(2, 0, 0) == 2
    assert g.arc_length(2, 1, 1) == pytest.approx(math.pi)
    assert g.arc_length(9, 1, 1) == pytest.approx(math.pi)


def test_bounds_and_dominant_type():
    s = g.path_segments("M0 0 L2 0 L2 3 Q1 1 -1 0 Q1 1 0 0")
    assert g.bounds(s) == (-1, 0, 2, 3)
    assert g.dominant_type(s) == "line"
    assert g.bounds([]) is None
