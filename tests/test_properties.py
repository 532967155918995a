"""Properties that hold for any input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.functions.text import readable
from marquee.operators import chunks
from marquee.sources.endpoint import pages

sizes = st.lists(st.integers(1, 60), max_size=60)


@settings(max_examples=200, deadline=None)
@given(sizes, st.integers(1, 40), st.integers(0, 30), st.integers(0, 39))
def test_spans_keep_order_and_bounds(items, target, more, overlap):
    p = chunks.Policy(target, target + more, min(overlap, target - 1), 1)
    seen = 0
    for a, b in chunks.spans(items, p):
        assert a < b and a <= seen and b >= seen  # no gap; an overlap without room for more may stand alone
        seen = b
        assert sum(items[a:b]) <= p.maximum or b == a + 1
    assert seen == len(items)


@given(st.text(alphabet="ab {}[]|'<>=\n", max_size=60))
def test_readable_is_collapsed(text):
    out = readable(text)
    assert out == " ".join(out.split()) and "{{}}" not in out


@given(st.lists(st.text(max_size=3), max_size=30), st.integers(1, 7))
def test_pages_cover(ids, size):
    got = list(pages(ids, size))
    assert [x for p in got for x in p] == ids and all(0 < len(p) <= size for p in got)


def test_rounding_is_of_the_binary_value(spark):
    """As Python's: 2.675 and 1.005 lie below their halves."""
    from marquee.functions.values import rounded

    rng = np.random.default_rng(1)
    xs = [0.0, 2.675, 1.005, 0.125, 0.375, 2.5, 33.335, 66.665, 0.005, 0.015, 1e-9, 99.995, 100.0, 1e9 + 0.125, -2.675, *(rng.integers(0, 10**6, 300) / 1000).tolist(), *(100 * rng.integers(0, 400, 300) / rng.integers(400, 900, 300)).tolist()]
    got = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", rounded(F.col("x")).alias("r")).collect()
    assert all(r["r"] == round(r["x"], 2) for r in got)
