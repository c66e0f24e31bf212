from __future__ import annotations

from datetime import datetime, timedelta

from hypothesis import given
from hypothesis import strategies as st

from tsq.timemath import EPOCH, SECOND, Duration, Instant, TimeRange

small = st.integers(-(10**12), 10**12)


def test_arithmetic():
    assert Duration(1500) / Duration(1000) == 1 and Duration(-1500) / Duration(1000) == -1
    assert Duration(-1500) / 1000 == Duration(-1)
    assert 3 * SECOND == SECOND * 3 == Duration.from_secs(3)
    assert Instant(5) - Instant(2) == Duration(3) and Instant(5) - Duration(2) == Instant(3)
    assert Instant(-1500) / SECOND == -1 and EPOCH + SECOND == Instant(1000)
    assert Instant.of("2024-01-01").millis == 1704067200000 == Instant.of(datetime(2024, 1, 1)).millis
    assert Duration.of(timedelta(minutes=1)).as_millis() == 60_000
    assert str(Instant(0)) == "1970-01-01 00:00:00 UTC"
    assert Instant.now() > Instant.from_millis(0)


def test_ranges():
    a, b = Instant(1), Instant(2)
    assert not TimeRange(a, b).is_empty() and TimeRange(b, a).is_empty() and TimeRange(a, a).is_empty()
    assert not TimeRange().is_empty() and not TimeRange(a, None).is_empty()
    assert TimeRange(a, None) & TimeRange(None, b) == TimeRange(a, b)


@given(small, small, small, small)
def test_intersection_holds_what_both_hold(a, b, c, d):
    x, y = TimeRange(Instant(a), Instant(b)), TimeRange(Instant(c), Instant(d))
    both = x & y
    for t in (a, b, c, d, a - 1, b - 1):
        inside = lambda r: r.start.millis <= t < r.end.millis
        assert inside(both) == (inside(x) and inside(y))
