"""Fingerprints, bit planes, links and components against plain Python."""

import random
import re

import numpy as np
import xxhash

from rankweave.llm.components import components
from rankweave.llm.simhash import fingerprint, near_duplicates, one_of_each, within
from tests.llm.conftest import ODD

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[k:k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_fingerprints():
    for text in [t for _, t in ODD if t is None or len(t) < 1000] + ["a b c d a b c", "A\x0bB\x85c", "tie tie"]:
        assert fingerprint((text or "").encode()) == plain_print(text)


def test_bit_planes_find_every_close_pair():
    draw = np.random.default_rng(1)
    for bits, radius, size in ((16, 2, 300), (8, 1, 200), (24, 3, 250), (16, 2, 9), (16, 2, 2), (16, 2, 1)):
        free = draw.integers(0, 1 << 7, size).astype(np.uint64) << np.uint64(bits - 8)
        run = np.sort(draw.integers(0, 4, size))
        a, b = within(free, run, bits, radius)
        want = {(i, j) for i in range(size) for j in range(i + 1, size)
                if run[i] == run[j] and int(free[i] ^ free[j]).bit_count() <= radius}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_rows(table):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(12)]
    rows = list(ODD)
    for k in range(160):
        text = base[k % 12].split()
        for _ in range(k % 4):
            text[rng.randrange(300)] = rng.choice(words)
        rows.append((100 + k, " ".join(text)))
    got = near_duplicates(table(rows)).collect()
    assert len(got) == len(rows)
    prints = {}
    for doc_id, text in rows:
        prints.setdefault(plain_print(text), []).append(doc_id)
    assert sorted((r.id, r.print & (2 ** 64 - 1)) for r in got if r.id) == sorted(
        (i, p) for p, ids in prints.items() for i in ids if i)
    named = {p: min(i for i in ids if i is not None) for p, ids in prints.items() if any(i is not None for i in ids)}
    links = [(named[p], named[q]) for p in named for q in named if p < q and (p ^ q).bit_count() <= 2]
    assert links
    roots = plain_components(named.values(), links)
    assert all(r.component == roots[named[r.print & (2 ** 64 - 1)]] for r in got if r.id is not None)
    stay = one_of_each(table(rows, "component", "gone_id")).collect()
    assert {r.doc_id for r in stay if r.doc_id} == {roots[n] for n in named.values()}


def test_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 300)] + [(1000, k) for k in range(1001, 1300)] + [(5, 5), (7, 6)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(2, 301)} | {k: 1000 for k in range(1001, 1300)}


def test_empty(table):
    assert near_duplicates(table([])).collect() == []
    assert one_of_each(table([])).collect() == []


def test_the_edges_of_a_hot_node_are_split(spark, tmp_path):
    """One node owns all edges: the join that hangs them is dealt over several tasks."""
    from rankweave.llm import components as C
    from tests.conftest import plan_of

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.files.maxPartitionBytes": "64k",
            "spark.sql.files.openCostInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(1, 60_001, 1, 16).selectExpr("id AS u", "0L AS v")
        hung = C._large_star(edges)
        assert hung.count() == 60_000
        hung.write.format("noop").mode("overwrite").save()
        both = C.written(edges.selectExpr("v AS u", "u AS v").unionByName(edges), "both")
        least = C.written(both.groupBy("u").agg({"v": "min"}).toDF("u", "m"), "least")
        joined = both.join(least, "u")
        joined.collect()
        assert "skew=true" in plan_of(joined)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert C.components(edges).where("v = 0").count() == 60_000
