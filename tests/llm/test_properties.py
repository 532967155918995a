"""Properties of the kernels for any input."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import kernels, packing, repeats, warc

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\xa0", max_size=40)), min_size=1, max_size=12)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(rows):
    data, offs = kernels.raw(pa.array(rows, pa.string()))
    starts, ends, at = kernels.word_bounds(data, offs)
    buf = data.tobytes()
    got = [[buf[a:b].decode() for a, b in zip(starts[x:y], ends[x:y], strict=True)] for x, y in zip(at[:-1], at[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in rows]


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 4))
def test_shingles_are_sets(rows, k):
    h, ends = kernels.shingles(pa.array(rows, pa.string()), k)
    sets = []
    for t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    assert np.diff(ends).tolist() == [len(s) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            assert len(np.intersect1d(h[ends[i] : ends[i + 1]], h[ends[j] : ends[j + 1]])) == len(a & b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 6), st.integers(-2, 2), st.integers(0, 9)), max_size=60))
def test_again_leaves_the_first(rows):
    h, ids, tags, pos = (np.array([r[c] for r in rows], t) for c, t in enumerate((np.uint64, np.int64, np.int64, np.int32)))
    first = {}
    for a, *place in sorted(set(rows)):
        first.setdefault(a, place)
    want = sorted((*place, a) for a, *place in rows if first[a] != place)
    assert sorted((int(ids[o]), int(tags[o]), int(pos[o]), int(h[o])) for o in repeats.again(h, np.zeros_like(h), ids, tags, pos, False)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_bins_hold_their_items(items):
    items.sort(reverse=True)
    where, final = packing.pack(items, (16, 32, 64))
    used = [0] * len(final)
    for n, b in zip(items, where, strict=True):
        used[b] += n
    assert all(0 < u <= c for u, c in zip(used, final, strict=True)) and len(where) == len(items)


@given(st.one_of(st.none(), st.integers(0, 99)), st.one_of(st.none(), st.text(max_size=9)), st.binary(max_size=50))
def test_record_round_trip(page, url, payload):
    import zstandard

    data = zstandard.ZstdCompressor().compress(warc.record(page, url, payload, "d", None, 0))
    ((headers, block),) = list(warc.records(data))
    assert block.partition(b"\r\n\r\n")[2] == payload and headers["WARC-Type"] == "response"
