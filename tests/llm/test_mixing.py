"""Targets, the knapsack and the mix."""

from collections import Counter
from itertools import product

import numpy as np

from rankweave.llm.mixing import knapsack, mix, mixed, plan
from tests.llm.conftest import ODD


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, found, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return found | {s: left * weight[s] / total for s in open_}
        for s in full:
            found[s] = most * sizes[s]
            left -= most * sizes[s]
            open_.remove(s)
    return found


def test_knapsack_is_as_good_as_trying_all():
    draw = np.random.default_rng(2)
    for _ in range(60):
        lengths = np.unique(draw.integers(1, 30, 4))
        counts = draw.integers(0, 4, len(lengths))
        budget = int(draw.integers(0, 120))
        got = knapsack(lengths, counts, budget)
        best = max(s for t in product(*(range(c + 1) for c in counts)) if (s := int(np.dot(t, lengths))) <= budget)
        assert (got <= counts).all() and int((got * lengths).sum()) == best


def test_plan_stays_near_its_target():
    draw = np.random.default_rng(3)
    for _ in range(30):
        lengths = np.unique(draw.integers(1, 4000, 200))
        counts = draw.integers(1, 50, len(lengths))
        total = int((lengths * counts).sum())
        target = float(draw.uniform(0, 2) * total)
        times = plan(lengths, counts, target, reach=1 << 12)
        assert (times <= 2 * counts).all() and abs(int((times * lengths).sum()) - target) <= 1
    assert plan(np.array([5]), np.array([3]), 0.0).tolist() == [0]
    assert plan(np.array([5]), np.array([3]), 99.0).tolist() == [6]


def rows_of_many():
    rows = [(k, "w " * (k % 37), "hot") for k in range(900)] + [(k, "w " * (k % 11 + 1), f"s{k % 4}") for k in range(900, 1100)]
    return rows + [(2000, "a b c", None), (2001, "a b c", "")] + [(i, t, "odd") for i, t in ODD]


def test_rows(table):
    rows = rows_of_many()
    docs = table(rows, "size", "key", "named", "part")
    got = mixed(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").replace(" ", "x").replace(" ", "x").replace("　", "x").split())
    targets, taken = plain_targets(sizes), Counter()
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[r.source]
        assert abs(r.target - targets[r.source]) < 1e-6
        taken[r.source] += r.taken
    longest = {s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(2, longest[s])
    assert abs(taken["hot"] - targets["hot"]) <= 1
    again = mixed(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_the_mix_has_the_rows_taken(table):
    rows = rows_of_many()
    docs = table(rows, "copies")
    got = mix(docs)
    assert got.columns == [*docs.columns, "size", "source_size", "target", "copies_", "taken"]
    counts = Counter(repr(r.id) for r in mixed(docs).collect() if r.copies)
    assert Counter(repr(r.doc_id) for r in got.collect()).keys() == counts.keys()


def test_empty(table):
    assert mixed(table([])).collect() == []
    assert mix(table([])).collect() == []
    assert [r.taken for r in mixed(table([(1, ""), (2, None)])).collect()] == [0, 0]


def test_documents_longer_than_the_reach_are_taken():
    assert plan(np.array([90_000, 200_000]), np.array([1, 1]), 100_000.0).tolist() == [1, 0]
    draw = np.random.default_rng(5)
    for _ in range(40):                                  # few documents: as good as trying all
        lengths = np.unique(draw.integers(1, 400_000, 5))
        counts = np.ones(len(lengths), np.int64)
        target = int(draw.uniform(0, 1) * lengths.sum())
        got = int((plan(lengths, counts, float(target)) * lengths).sum())
        assert got == max(s for t in product(*[range(2)] * len(lengths)) if (s := int(np.dot(t, lengths))) <= target)
    for _ in range(5):                                   # many: next to the target
        lengths = np.unique(draw.integers(70_000, 300_000, 60))
        counts = draw.integers(1, 4, len(lengths))
        target = float(draw.uniform(0.1, 1.9) * (lengths * counts).sum())
        times = plan(lengths, counts, target)
        assert (times <= 2 * counts).all() and -1 <= target - int((times * lengths).sum()) <= 20


def test_names_that_differ_in_case_only(table):
    docs = table([(i, "word " * (1 + i % 7), f"s{i % 3}") for i in range(60)], "Size", "TARGET", "Copies_")
    found = mix(docs)
    assert found.columns[:len(docs.columns)] == docs.columns and found.count() > 0
    assert len({c.lower() for c in found.columns}) == len(found.columns)
