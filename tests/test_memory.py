"""Rows of Arrow batches do not all become Python objects at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tomelight.functions import html as H
from tomelight.operators import curation, labelling as L


def _peak(f, *columns):
    """The result of f, and the most bytes that Python and numpy held meanwhile."""
    tracemalloc.start()
    try:
        return f(*columns), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_viterbi_holds_no_objects():
    rng = np.random.default_rng(3)
    step = np.array([[0.5, -1.0, 0.0], [-1.0, 0.5, 0.1], [0.2, 0.0, 0.3]])
    rows = [None if k % 50 == 7 else rng.normal(size=(k % 400, 3)).round(1).tolist() for k in range(2000)]
    found, peak = _peak(lambda x: L.best_paths(x, step), pa.array(rows, pa.list_(pa.list_(pa.float64()))).slice(3))
    assert peak < 60e6  # the scores are 9.6 MB; as arrays of Python, a hundred bytes and more for each token
    for row, path in zip(rows[3:], found.to_pylist(), strict=True):
        best, came = (np.array(row[0]), []) if row else (None, [])
        for x in (row or [])[1:]:
            both = best[:, None] + step
            came.append(both.argmax(axis=0))
            best = both.max(axis=0) + np.array(x)
        own = [int(best.argmax())] if row else []
        for b in reversed(came):
            own.append(int(b[own[-1]]))
        assert path == own[::-1]


def test_strip_html_holds_few_pages():
    pages = pa.array(["<p>a &amp; " + "b " * 5000 + "<script>x</script>", None] * 1000)
    found, peak = _peak(H.strip_html.func, pages)
    assert peak < 5e6  # the pages are 10 MB
    assert found.to_pylist() == ["a & " + "b " * 4999 + "b", ""] * 1000


def test_entities_and_spans_hold_few_rows():
    tags = pa.array([["B-A", "I-A", "O"] * 1000, None] * 200)
    found, peak = _peak(L.bio_entities.func, tags)
    assert peak < 15e6  # 600,000 tags, 200,000 entities
    assert found.to_pylist() == [[{"type": "A", "first": k, "last": k + 1} for k in range(0, 3000, 3)], []] * 200
    terms = pa.array([[{"text": "ab", "label": "A"}] * 1000, None] * 200)
    found, peak = _peak(curation.placed_spans.func, pa.array(["ab " * 1000, "x"] * 200), terms)
    assert peak < 15e6
    assert found.to_pylist() == [[{"start": k, "end": k + 2, "term": "ab", "label": "A"} for k in range(0, 3000, 3)], []] * 200
