"""Windows of benchmark items against a plain scan."""

import random
import re

import pytest

from rankweave.llm.decontaminate import contamination, without_contaminated, without_spans
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text, items, window=10):
    words = WORD.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for item, line in items:
        parts = WORD.findall((line or "").translate(LOW))
        width = min(window, len(parts))
        asked = {tuple(parts[k:k + width]) for k in range(len(parts) - width + 1)} if width else set()
        for k in range(len(words)):
            if asked and tuple(words[k:k + width]) in asked and k + width <= len(words):
                hit.update(range(k, k + width))
                found.add(item)
    return len(words), len(hit), found - {None}


@pytest.fixture(scope="module")
def case(spark, table):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 9, 10, 11, 30])))) for k in range(20)]
    items += [(3, "Repeated id, of few words"), (100, ""), (101, None), (None, "no id but words"), (102, "one")]
    rows = list(ODD)
    for k in range(120):
        parts = rng.choices(words, k=rng.randrange(0, 40))
        if k % 3 == 0:
            line = items[k % 20][1].split()
            at = rng.randrange(0, len(line))
            parts[len(parts) // 2:len(parts) // 2] = line[at // 2:]
        rows.append((200 + k, ", ".join(parts).upper() if k % 2 else " ".join(parts)))
    rows += [(500, "repeated id of few words no id but words")]
    return rows, items, table(rows), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [16 << 20, 200])
def test_rows(case, block):
    rows, items, docs, benchmark = case
    got = contamination(docs, benchmark, keep=["doc_id"], block_bytes=block).collect()
    want = sorted((repr(i), n, h, sorted(f)) for i, t in rows for n, h, f in [plain(t, items)])
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, sorted(r["items"])) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)


def test_documents_or_spans_go(case):
    rows, items, docs, benchmark = case
    stay = without_contaminated(docs, benchmark)
    assert stay.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in stay.collect()))) == sorted(
        repr(i) for i, t in rows if not plain(t, items)[1])
    cut = without_spans(docs, benchmark).collect()
    assert len(cut) == len(rows)
    assert {r.doc_id: r.text for r in cut}[6] == dict(rows)[6]
    longest = [r for r in cut if r.doc_id == 500][0]
    assert longest.text.strip() == ""


def test_empty_sides_and_clashing_names(spark, table):
    empty = spark.createDataFrame([], "item_id string, text string")
    docs = table(ODD, "n_words", "n_hit", "spans", "items", "scanned_text")
    got = contamination(docs, empty)
    assert got.columns == [*docs.columns, "n_words_", "n_hit_", "spans_", "items_"]
    assert {r.n_hit_ for r in got.collect()} == {0}
    assert without_contaminated(docs, empty).count() == len(ODD)
    one = spark.createDataFrame([("a", "some words")], "item_id string, text string")
    assert contamination(table([]), one).collect() == []


def test_names_that_differ_in_case_only(spark, table):
    docs = table([(1, "one two three four five six seven eight nine ten"), (2, "clean text")], "SPANS", "Items", "N_hit", "Scanned_Text")
    bench = spark.createDataFrame([("a", "one two three four five six seven eight nine ten")], "item_id string, text string")
    kept = without_contaminated(docs, bench)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
    assert without_spans(docs, bench).columns == docs.columns
