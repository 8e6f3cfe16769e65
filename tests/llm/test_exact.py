"""Exact duplicates against a dictionary of the normalised texts."""

import hashlib

from rankweave.llm.exact import ROW, deduplicated, exact_duplicates, runs, sorted_runs
from tests.conftest import plan_of
from tests.llm.conftest import ODD

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, pick):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(LOW), []).append(doc_id)
    out = []
    for doc_id, text in rows:
        line = (text or "").translate(LOW)
        ids = [i for i in groups[line] if i is not None]
        keep = pick(ids) if ids else None
        out.append((doc_id, keep, len(groups[line]), doc_id == keep, hashlib.sha256(line.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_all_rows(table):
    rows = ODD + [(20, "İI"), (21, "iI"), (22, "ii"), (23, "ÉCOLE"), (24, "école"), (25, "école")]
    for keep, pick in (("min", min), ("max", max)):
        got = [tuple(r) for r in exact_duplicates(table(rows), keep=keep).collect()]
        assert sorted(got, key=repr) == expected(rows, pick)


def test_a_text_that_owns_most_rows(table):
    rows = [(k, "the hot text") for k in range(3000)] + [(k, f"text {k % 700}") for k in range(3000, 5000)]
    got = [tuple(r) for r in exact_duplicates(table(rows), keep="max").collect()]
    assert sorted(got, key=repr) == expected(rows, max)


def test_one_row_stays_with_all_columns(table):
    docs = table(ODD, "row_key", "row_sha256", "salt", "line", "id")
    got = deduplicated(docs, keep="max")
    assert got.columns == docs.columns
    texts = [(r.text or "").translate(LOW) for r in got.collect()]
    assert sorted(texts) == sorted({(t or "").translate(LOW) for _, t in ODD})
    assert {r.doc_id for r in got.collect() if (r.text or "").lower() == "same words here again"} == {5}


def test_empty(table):
    assert exact_duplicates(table([])).collect() == []
    assert deduplicated(table([])).collect() == []


def test_neighbours_are_compared_in_sorted_ranges(spark, table):
    df = runs(table([(k, f"text {k % 5}") for k in range(50)]))
    plan = plan_of(df)
    assert "rangepartitioning" in plan and "SortAggregate" in plan and "Python" not in plan and "Arrow" not in plan


def test_copies_stand_together_before_any_digest(table):
    """Each text is one run in the sorted ranges, found by full comparison."""
    rows = [(k, f"text {k % 7}") for k in range(500)]
    got = {r.line: (r.keep_id, r.n) for r in sorted_runs(table(rows)).collect()}
    assert len(sorted_runs(table(rows)).collect()) == 7
    assert got == {f"text {k}": (k, sum(i % 7 == k for i in range(500))) for k in range(7)}


def test_only_hot_texts_are_cut(table):
    """A text over the bound gets as many salts as it holds bounds, others one run."""
    rows = [(k, "the hot text") for k in range(3000)] + [(k, f"text {k}") for k in range(3000, 3100)] * 2
    hot = 250 * (len("the hot text") + ROW)
    found = sorted_runs(table(rows), hot=hot).collect()
    cut = [r for r in found if r.line == "the hot text"]
    assert len(cut) == 12 and sum(r.n for r in cut) == 3000
    assert sorted(r.n for r in found if r.line != "the hot text") == [2] * 100
    sizes = {r.keep_id: r.group_size for r in runs(table(rows), hot=hot).collect()}
    assert sizes[0] == 3000 and len(sizes) == 101


def test_many_empty_texts_are_cut_too(table):
    found = sorted_runs(table([(k, None if k % 2 else "") for k in range(2000)]), hot=100 * ROW).collect()
    assert len(found) == 20 and sum(r.n for r in found) == 2000
