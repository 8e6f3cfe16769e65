"""Keyword search against a plain Python account of its rules."""

import math
import pickle
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rankweave.functions.text import STOP_WORDS
from rankweave.operators import keyword as K
from rankweave.operators.conditions import near_places
from tests.conftest import plan_of, rows_of

FIELDS = ("title", "body")


def py_words(text):
    return [w for w in re.split(r"[^0-9a-z]+", (text or "").lower()) if w]


def py_leaf(text):
    """(is_prefix, words) of one term."""
    return text.rstrip('"').endswith("*"), tuple(py_words(text))


def py_starts(term, ws):
    """Places where the first indexed word of a term stands, and the words it spans."""
    prefix, words = term
    need = [(i, w) for i, w in enumerate(words) if w not in STOP_WORDS]
    base = need[0][0]
    ok = [
        p for p in range(len(ws))
        if all(0 <= p + i - base < len(ws) and ws[p + i - base] not in STOP_WORDS
               and (ws[p + i - base].startswith(w) if prefix else ws[p + i - base] == w) for i, w in need)]
    return ok, need[-1][0] - base + 1


def py_count(leaf, ws):
    if leaf[0] != "near":
        return len(py_starts(leaf, ws)[0])
    found = [py_starts(t, ws) for t in leaf[1]]
    reach = leaf[2] + sum(width for _, width in found)
    opened = {
        p for k, (starts, _) in enumerate(found) for p in starts
        if all(any(p < q and q + width <= p + reach for q in other) for u, (other, width) in enumerate(found) if u != k)}
    return len(opened)


def py_tree(tree):
    """Conditions of the tests as trees by hand: ("or"|"and", ...), ("not", x), a text, or ("near", terms, n)."""
    if isinstance(tree, str):
        return py_leaf(tree)
    if tree[0] == "near":
        return ("near", tuple(py_leaf(t) for t in tree[1]), tree[2])
    return (tree[0], *map(py_tree, tree[1:]))


def py_flat(condition):
    """A condition without parentheses as a tree."""
    groups, ops = [], []
    for p in re.findall(r'"[^"]*"\*?|[^\s"]+', condition):
        ops.append(p.upper())
        if ops[-1] in ("AND", "OR", "NOT"):
            continue
        neg = len(ops) > 1 and ops[-2] == "NOT"
        before = ops[-3:-2] if neg else ops[-2:-1]
        if any(w not in STOP_WORDS for w in py_words(p)):
            part = ("not", py_leaf(p)) if neg else py_leaf(p)
            if before == ["AND"] and groups:
                groups[-1].append(part)
            else:
                groups.append([part])
        elif before != ["AND"]:
            groups.append([])
    return ("or", *[("and", *g) for g in groups if g])


def py_search(corpus, condition, fields=FIELDS):
    """{case_id: score} by direct counting; `condition` is a flat text or a tree."""
    tree = py_flat(condition) if isinstance(condition, str) else py_tree(condition)

    def leaves(t, below=False):
        if t[0] in ("or", "and"):
            return [x for part in t[1:] for x in leaves(part, below)]
        if t[0] == "not":
            return leaves(t[1], True)
        return [(t, below)]

    def holds(t, case):
        if t[0] == "or":
            return any(holds(p, case) for p in t[1:])
        if t[0] == "and":
            return any(p[0] != "not" for p in t[1:]) and all(holds(p, case) for p in t[1:])
        if t[0] == "not":
            return not holds(t[1], case)
        return case in tf[t]

    every = leaves(tree)
    tf = {leaf: {} for leaf, _ in every}
    dl = {}
    for case, texts in corpus.items():
        dl[case] = sum(w not in STOP_WORDS for f in fields for w in py_words(texts[f]))
        for leaf in tf:
            n = sum(py_count(leaf, py_words(texts[f])) for f in fields)
            if n:
                tf[leaf][case] = n
    avg = sum(dl.values()) / len(corpus)
    out = {}
    for case in corpus:
        if holds(tree, case):
            score = 0.0
            for k in {leaf for leaf, below in every if not below}:
                if case in tf[k]:
                    df, t = len(tf[k]), tf[k][case]
                    idf = math.log(1 + (len(corpus) - df + 0.5) / (df + 0.5))
                    score += idf * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * dl[case] / avg))
            out[case] = score
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["chest", "pain", "breath", "short", "shortness", "of", "the", "head", "heart", "at", "cough", "on"]
    made = {
        i: {"title": " ".join(rng.choices(vocabulary, k=rng.randint(0, 4))),
            "body": ", ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))}
        for i in range(60)
    }
    # A third of the cases are copies of one text.
    for i in range(60, 90):
        made[i] = {"title": "chest pain", "body": "shortness of breath at the heart"}
    return made


@pytest.fixture(scope="module")
def table(spark, corpus):
    return spark.createDataFrame(
        [(i, t["title"], t["body"]) for i, t in corpus.items()], "case_id long, title string, body string").repartition(4)


CONDITIONS = [
    "chest", "chest pain", '"chest pain"', '"shortness of breath" OR cough', "chest AND heart", "chest AND NOT pain",
    "head AND NOT heart OR cough AND chest", 'short* AND NOT "of"', "he*", '"short* brea*"', '"the pain"', '"pain the"',
    "the", "NOT chest", "missing OR nothing", "chest AND missing", "chest OR chest", "Chest pain pain AND NOT chest",
    'heart and head', '"chest the of pain" OR breath', '"chest pain" chest AND NOT "pain chest"',
]


def close(got, want):
    assert set(got) == set(want)
    for case, score in want.items():
        assert got[case] == pytest.approx(score, abs=2e-8)


# (condition, the same as a tree by hand)
NESTED = [
    ("(chest OR head) AND heart", ("or", ("and", ("or", "chest", "head"), "heart"))),
    ("chest AND (heart OR (pain AND NOT cough))", ("and", "chest", ("or", "heart", ("and", "pain", ("not", "cough"))))),
    ("chest AND NOT (pain OR heart)", ("and", "chest", ("not", ("or", "pain", "heart")))),
    ("((chest))", "chest"),
    ("(chest pain) AND (head heart)", ("and", ("or", "chest", "pain"), ("or", "head", "heart"))),
    ("(chest AND pain", ("and", "chest", "pain")),
    ("chest) AND pain", ("and", "chest", "pain")),
    ("() chest", "chest"),
    ("(the) AND chest", "chest"),
    ("(NOT chest) AND pain", ("and", ("or", ("and", ("not", "chest"))), "pain")),
    ('NOT (chest) OR "chest pain"', '"chest pain"'),
    ("chest AND NOT (NOT pain)", ("and", "chest", ("not", ("or", ("and", ("not", "pain")))))),
    ("NEAR(chest, pain, 2)", ("near", ("chest", "pain"), 2)),
    ("near((chest, pain, heart), 4) OR cough", ("or", ("near", ("chest", "pain", "heart"), 4), "cough")),
    ("NEAR(chest, heart, 0)", ("near", ("chest", "heart"), 0)),
    ('NEAR(short*, "of breath", 3) AND NOT cough', ("and", ("near", ("short*", "of breath"), 3), ("not", "cough"))),
    ('NEAR("chest of pain", heart, 5)', ("near", ("chest of pain", "heart"), 5)),
    ("NEAR(he*, heart, 6)", ("near", ("he*", "heart"), 6)),
    ("NEAR(chest, the, 3)", "chest"),
    ("NEAR(chest, chest, 3)", "chest"),
    ("NEAR((chest, head))", ("near", ("chest", "head"), 1 << 30)),
    ("NEAR((chest, head), MAX)", ("near", ("chest", "head"), 1 << 30)),
    ("NEAR(chest, missing, 9) OR NEAR(head, cough, 1", ("or", ("near", ("chest", "missing"), 9), ("near", ("head", "cough"), 1))),
    ("pain AND (NEAR(chest, heart, 3) OR head) AND NOT (cough AND on)", ("and", "pain", ("or", ("near", ("chest", "heart"), 3), "head"), ("not", "cough"))),
    ("near chest", ("or", "near", "chest")),
]


@pytest.mark.parametrize("condition,tree", NESTED)
def test_nested_and_near_scan(table, corpus, condition, tree):
    close(dict(rows_of(K.keyword_scan(table, FIELDS, condition))), py_search(corpus, tree))


@pytest.mark.parametrize("form", ["scan", "stored"])
def test_nested_and_near_in_a_batch(spark, table, corpus, stored, form):
    index = stored if form == "stored" else K.scan_index(table, FIELDS)
    requests = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(NESTED)], "query_id long, keyword_search string")
    got = {}
    for q, case, score in rows_of(K.keyword_search_batch(index, requests)):
        got.setdefault(q, {})[case] = score
    for q, (_, tree) in enumerate(NESTED):
        close(got.get(q, {}), py_search(corpus, tree))


def test_a_prefix_finds_no_stop_word(table, corpus):
    close(dict(rows_of(K.keyword_scan(table, FIELDS, "th* OR o* OR cough"))), py_search(corpus, "th* OR o* OR cough"))


def test_near_filters(stored, table):
    condition = '(NEAR(chest, heart, 3) OR "chest pain") AND NOT (cough OR head)'
    want = rows_of(K.contains_filter(table, FIELDS, condition), "case_id")
    assert want and rows_of(K.contains_index(stored, table, condition), "case_id") == want


@pytest.mark.parametrize("condition", CONDITIONS)
def test_scan_equals_brute_force(table, corpus, condition):
    close(dict(rows_of(K.keyword_scan(table, FIELDS, condition))), py_search(corpus, condition))


def test_batch_equals_brute_force(spark, table, corpus):
    requests = spark.createDataFrame(list(enumerate(CONDITIONS)), "query_id long, keyword_search string")
    got = {}
    for q, case, score in rows_of(K.keyword_search_batch(K.scan_index(table, FIELDS), requests)):
        got.setdefault(q, {})[case] = score
    for q, condition in enumerate(CONDITIONS):
        close(got.get(q, {}), py_search(corpus, condition))


def test_batch_without_broadcasts_and_in_small_pieces(spark, table, corpus, monkeypatch):
    monkeypatch.setattr(K, "TILE_WORDS", 50)
    monkeypatch.setattr(K, "BLOCK_QUESTIONS", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        requests = spark.createDataFrame(list(enumerate(CONDITIONS)), "query_id long, keyword_search string")
        got = {}
        for q, case, score in rows_of(K.keyword_search_batch(K.scan_index(table, FIELDS), requests)):
            got.setdefault(q, {})[case] = score
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for q, condition in enumerate(CONDITIONS):
        close(got.get(q, {}), py_search(corpus, condition))


@pytest.mark.parametrize("hits", [200_000, 7])
def test_stored_batch_equals_brute_force(spark, stored, corpus, hits, monkeypatch):
    monkeypatch.setattr(K, "PACK_HITS", hits)
    requests = spark.createDataFrame(list(enumerate(CONDITIONS)), "query_id long, keyword_search string")
    got = {}
    for q, case, score in rows_of(K.keyword_search_batch(stored, requests)):
        got.setdefault(q, {})[case] = score
    for q, condition in enumerate(CONDITIONS):
        close(got.get(q, {}), py_search(corpus, condition))


def test_no_requests(spark, table, stored):
    none = spark.createDataFrame([], "query_id long, keyword_search string")
    assert K.keyword_topk(K.scan_index(table, FIELDS), none, 3).collect() == []
    assert K.keyword_topk(stored, none, 3).collect() == []


def test_many_leaves(spark, table, corpus):
    condition = " OR ".join(f"w{i}" for i in range(80)) + " OR chest AND pain"
    requests = spark.createDataFrame([(1, condition)], "query_id long, keyword_search string")
    got = {c: s for _, c, s in rows_of(K.keyword_search_batch(K.scan_index(table, FIELDS), requests))}
    close(got, py_search(corpus, condition))


@pytest.fixture(scope="module")
def stored(table, tmp_path_factory):
    return K.build_index(table, str(tmp_path_factory.mktemp("index")), FIELDS, buckets=8)


@pytest.mark.parametrize("condition", ["chest pain", '"shortness of breath"', "he* AND NOT cough"])
@pytest.mark.parametrize("fields", [FIELDS, ("title",)])
def test_stored_index(stored, corpus, condition, fields):
    close(dict(rows_of(K.keyword_search(stored, condition, fields=fields))), py_search(corpus, condition, fields))


def test_stored_index_prunes_buckets(stored, table):
    assert re.search(r"PartitionFilters: \[[^\]]*term_bucket", plan_of(K.freetext_index(stored, table, "chest")))


@pytest.mark.parametrize("condition", ["chest pain", '"shortness of breath" AND NOT pain', "he* AND NOT cough"])
def test_filters_by_index_equal_filters_by_scan(stored, table, condition):
    assert rows_of(K.contains_index(stored, table, condition), "case_id") == rows_of(
        K.contains_filter(table, FIELDS, condition), "case_id")
    plain = condition.replace("*", "")
    for fields in (FIELDS, ("title",)):
        assert rows_of(K.freetext_index(stored, table, plain, fields), "case_id") == rows_of(
            K.freetext_filter(table, fields, plain), "case_id")
    assert K.freetext_index(stored, table, "of the").count() == 0


def test_limit_breaks_ties_by_id(table):
    top = rows_of(K.keyword_scan(table, FIELDS, '"shortness of breath at the heart"', 5))
    assert [c for c, _ in top] == [60, 61, 62, 63, 64] and len({s for _, s in top}) == 1


def test_scan_reads_the_text_once(table):
    hits = K.keyword_scan(table, FIELDS, "chest pain", 5)
    hits.collect()
    assert "ReusedExchange" in plan_of(hits)


def test_single_question_shuffles_no_text(table):
    plan = plan_of(K.keyword_scan(table, FIELDS, "chest"))
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "title" not in line and "body" not in line


def test_contains_and_freetext(cases):
    fields = ["chief_complaint", "symptoms"]
    got = K.contains_filter(cases, fields, '"chest pain" OR "shortness of breath"')
    assert sorted(r.case_id for r in got.collect()) == [12, 31]
    assert got.columns == cases.columns
    free = K.freetext_filter(cases, fields, "the patient cannot breathe, dyspnee")
    assert sorted(r.case_id for r in free.collect()) == [31, 32]
    assert K.freetext_filter(cases, fields, "of the").count() == 0


def test_blank_condition(table):
    with pytest.raises(ValueError):
        K.keyword_scan(table, FIELDS, "  ")


def test_result_does_not_depend_on_partitions(spark, table):
    requests = spark.createDataFrame([(1, "chest pain"), (2, '"of breath"')], "query_id long, keyword_search string")
    index = K.scan_index(table, FIELDS)
    before = rows_of(K.keyword_topk(index, requests, 7), "query_id", "keyword_rank")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        after = rows_of(K.keyword_topk(K.scan_index(table.repartition(7), FIELDS), requests, 7), "query_id", "keyword_rank")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert before == after


def test_postings(spark, cases):
    rows = K.build_postings(cases, ("symptoms",)).where("term = 'chest'").select("case_id", "tf", "positions")
    assert rows_of(rows, "case_id") == [(12, 1, [0]), (31, 1, [3]), (45, 1, [4])]
    lens = K.case_lengths(K.build_postings(cases, ("symptoms", "outcome"), lengths=True))
    assert rows_of(lens.where("case_id = 45")) == [(45, [2, 0])] and lens.count() == 5
    assert "Exchange" not in plan_of(K.build_postings(cases, ("symptoms",)))


def test_a_task_keeps_the_best_hits_of_each_question():
    rng = np.random.default_rng(6)
    block = K._Block([], [(7, []), (9, []), (7, [])])
    rows = [(q, c, float(s)) for c in range(400) for q, s in enumerate(rng.integers(1, 60, 3) / 10) if (c + q) % 3]
    top = K._Top(block, 5)
    for lo in range(0, len(rows), 50):
        top.add(*(np.array(x) for x in zip(*rows[lo:lo + 50], strict=True)))
        top.trim()
    want = [(block.questions[q][0], c, s) for q in range(3)
            for _, c, s in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:5]]
    assert [tuple(r.values()) for r in top.rows().to_pylist()] == want


def test_statistics_are_one_row_for_each_block_of_a_task():
    tiles = [K._Tile(np.arange(2 * i, 2 * i + 2), [pa.array([["chest", "the", "pain"], ["pain"]])], ["the"]) for i in range(4)]
    block = K._Block([K.make_leaf([(["pain"], False)], None, ["the"])], [(1, [])])
    rows = [(pickle.dumps(t), b, pickle.dumps(block)) for t in tiles for b in (3, 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)],
                                       names=["tile", "block", "questions"])
    found = [r for b in K._count_tiles(iter([batch])) for r in b.to_pylist()]
    assert found == [{"block": b, "n": 8, "len": 12, "leaf": [0], "df": [8]} for b in (3, 4)]


def test_an_index_stores_blocks_of_postings(spark, tmp_path):
    """One row for a word in a run of cases, not one for each case and field."""
    rows = [(i, "chest pain of the chest", None if i % 3 else f"pain w{i}") for i in range(300)] + [(7, "chest", "")]
    table = spark.createDataFrame(rows, "case_id long, title string, body string").coalesce(1)
    index = K.build_index(table, str(tmp_path), FIELDS, buckets=4)
    assert spark.read.parquet(str(tmp_path / "postings")).count() == 2 + 100 + 1
    columns = ["term_bucket", "term", "case_id", "field", "tf", "positions"]
    want = K.build_postings(table, FIELDS, buckets=4, lengths=True)
    assert sorted(map(str, rows_of(K.unfolded(index.postings).select(*columns)))) == sorted(
        map(str, rows_of(want.where("term_bucket >= 0").select(*columns))))
    assert sorted(rows_of(index.lengths)) == sorted(rows_of(K.case_lengths(want)))
    # names come from the index, whichever order a reader asks in
    other = K.read_index(spark, str(tmp_path), FIELDS[::-1])
    assert rows_of(K.unfolded(other.postings).where("term = 'w3'").select("case_id", "field", "positions")) == [(3, "body", [1])]


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_runs_of_any_size_hold_the_same_postings(size, monkeypatch):
    monkeypatch.setattr(K, "RUN_WORDS", size)
    texts = [["chest of pain", "", "pain", "pain pain chest"], ["", "", "cough", "chest"]]
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7, 5]), *map(pa.array, texts)], names=["case_id", "ws0", "ws1"])
    got, lens = [], []
    for out in K._folded(iter([batch]), 2, ["of"]):
        for r in out.to_pylist():
            places = [r["positions"][a:b] for a, b in zip([0, *r["ends"]], r["ends"])]
            target = got if r["term"] else lens
            target += [(r["term"], *x) for x in zip(r["case_ids"], r["fields"], places, strict=True)]
    assert sorted(got) == [("chest", 5, 0, [0]), ("chest", 5, 0, [2]), ("chest", 5, 1, [0]), ("cough", 7, 1, [0]),
                           ("pain", 5, 0, [0, 1]), ("pain", 5, 0, [2]), ("pain", 7, 0, [0])]
    assert [x[1:] for x in lens] == [(5, -1, [2, 0]), (6, -1, [0, 0]), (7, -1, [1, 1]), (5, -1, [3, 1])]


def test_places_of_near_are_counted_as_arrays():
    """Also in a slice of a batch; no list of places is made."""
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    rows = [("n", 1, 0, [1, 1], [0], [4]), ("n", 2, 2, [1, 1], [0, 1, 1], [4, 5, 9]), ("n", 3, 2, [1, 1], [0, 1], [1, 9])]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                       names=["leaf", "case_id", "window", "widths", "sub", "start"])
    want = [len(near_places([np.array([p for s, p in zip(r[4], r[5], strict=True) if s == k]) for k in (0, 1)], r[3], r[2])) for r in rows]
    got = [r["tf"] for b in K._count_near(iter([batch, batch.slice(1)])) for r in b.to_pylist()]
    assert got == want + want[1:] and want[1] > 0


def scan_case(seed, cases=60, questions=40):
    """Tiles of random words, and a block of questions of one to three leaves, some of them phrases or with NOT."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(25)], k=rng.randrange(1, 30))) for _ in range(3 * cases)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(lo, lo + cases)), pa.array(texts[lo:lo + cases])], names=["case_id", "ws0"])
               for lo in range(0, 3 * cases, cases)]
    names = [*words, "w0 w1", "w2 w0", "gone"]
    leaves = [K.make_leaf([(name.split(), False)], None, []) for name in names]
    trees = [[[(False, k)] for k in rng.sample(range(len(names)), rng.randrange(1, 4))] for _ in range(questions)]
    trees.append([[(False, 0), (True, 1)]])
    return [t for b in batches for t in K._tiles(iter([b]), 1, [])], K._Block(leaves, [(100 + q, tree) for q, tree in enumerate(trees)])


def scored_tiles(tiles, block, limit):
    counters = [K._Counter(t) for t in tiles]
    df = sum(c.frequencies(block) for c in counters)
    n, length = sum(len(t.ids) for t in tiles), sum(int(c.length.sum()) for c in counters)
    rows = ((0, block, c if limit else K._counted(c, block), n, length, list(range(len(df))), df.tolist()) for c in counters)
    return [tuple(r.values()) for b in K._best_hits(rows, limit, 1.2, 0.75) for r in b.to_pylist()]


@pytest.mark.parametrize("limit", [1, 4, 500])
@pytest.mark.parametrize("dense_from, cells", [(0, 1 << 24), (1 << 40, 1 << 24), (1 << 40, 200), (3, 1 << 24)])
def test_the_best_hits_of_tiles_are_those_of_all_scores(limit, dense_from, cells, monkeypatch):
    monkeypatch.setattr(K, "DENSE_FROM", dense_from)
    monkeypatch.setattr(K, "TABLE_CELLS", cells)
    monkeypatch.setattr(K, "WAITING_HITS", 20)
    monkeypatch.setattr(K, "CANDIDATE_PAIRS", 50)
    tiles, block = scan_case(limit)
    want = []
    for q, _ in block.questions:
        want += sorted((r for r in scored_tiles(tiles, block, None) if r[0] == q), key=lambda r: (-r[2], r[1]))[:limit]
    assert scored_tiles(tiles, block, limit) == want and want


def test_few_cases_of_a_question_are_scored(monkeypatch):
    """Before, every question was scored in every case of a tile."""
    tiles, block = scan_case(2, cases=2000)
    looked_up = []
    find = K._Postings.find
    monkeypatch.setattr(K._Postings, "find", lambda self, code, row: looked_up.append(len(code)) or find(self, code, row))
    monkeypatch.setattr(K, "WAITING_HITS", 20)
    scored_tiles(tiles, block, 3)
    assert 0 < sum(looked_up) < 41 * 6000 / 20


def test_blocks_beyond_what_a_task_holds_come_in_groups(spark, table, corpus, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_QUESTIONS", 4)
    monkeypatch.setattr(K, "HELD_HITS", 30)
    requests = spark.createDataFrame(list(enumerate(CONDITIONS)), "query_id long, keyword_search string")
    assert K._groups(len(CONDITIONS) // 4, 3) > 1
    got = {}
    for q, case, score, rank in rows_of(K.keyword_topk(K.scan_index(table, FIELDS), requests, 3), "query_id", "keyword_rank"):
        got.setdefault(q, []).append((case, score))
    for q, condition in enumerate(CONDITIONS):
        every = py_search(corpus, condition)
        close(dict(got.get(q, [])), {c: every[c] for c, _ in got.get(q, [])})
        best = sorted(every.items(), key=lambda x: (-round(x[1], 8), x[0]))[:3]
        assert [c for c, _ in got.get(q, [])] == [c for c, _ in best]


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_hits_are_put_in_order_by_one_number_or_three(scale):
    rng = np.random.default_rng(1)
    question, cases = rng.integers(0, 9, 500), rng.permutation(500)
    score = np.round(rng.integers(1, 20, 500) / 7 * scale, 8)
    assert (K._ranked_order(question, score, cases) == np.lexsort((cases, -score, question))).all()
