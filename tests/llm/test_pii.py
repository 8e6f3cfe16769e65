"""Personal data against plain regexes."""

import re

import pytest

from rankweave.llm.pii import KINDS, as_line, personal_data
from tests.conftest import plan_of
from tests.llm.conftest import ODD

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in hit.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain(text, kind):
    return [(m.start(), m.end()) for m in re.finditer(BASE[kind], text or "") if passes(kind, m[0])]


TEXTS = [
    "a@b.c", "x a.b+c@d-e.f.g, y", "a@b.c_x@y.z", "@a.b a@b a@b.", "a@b.c@d.e", "é@b.c 😀 q@r.st", "a" * 3000 + "@b.c", "a" * 50_000,
    "1.2.3.4", "1.2.3.4.5", "256.1.1.1 255.255.255.255", "1.2.3.45.6.7.8", "1..2.3.4.5", "001.02.3.0255", "0.0.0.0", "00000000000256.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "4111  1111 1111 1111", "5" * 40, "0000000000000", "4111 1111 1111 1111 2",
    "+1 (988) 555-2485 z", "+49 30 1234567.", "+12", "+1 23", "+1 2345678901234567", "+1+2 333 444 555", "+1 " + "5 " * 8 + "  x", "+1" + " " * 5000,
    "4111 1111 1111 1111 " * 300, "mail a@b.cc " * 500]


def test_base_kinds(table):
    rows = list(enumerate(TEXTS, 100)) + ODD
    got = personal_data(table(rows, "id", "email", "ip")).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t for i, t in rows if i == r.id]
        for kind in BASE:
            assert [(s.start, s.end) for s in r[kind]] in [plain(t, kind) for t in texts], (r.id, kind)


@pytest.mark.parametrize("text, kind, found", [
    ("IBAN DE89 3704 0044 0532 0130 00 ok", "iban", [(5, 32)]), ("GB82WEST12345698765432", "iban", [(0, 22)]),
    ("DE89 3704 0044 0532 0130 01", "iban", []), ("AB12", "iban", []),
    ("his SSN is 123-45-6789.", "ssn", [(11, 22)]), ("part 123-45-6789", "ssn", []),
    ("123-45-6789 (SSN)", "ssn", [(0, 11)]), ("123-45-6789 is my social security number", "ssn", [(0, 11)]),
    ("123-45-6789" + " word" * 12 + " ssn", "ssn", []), ("ssn 000-45-6789", "ssn", [])])
def test_method_kinds(table, text, kind, found):
    row = personal_data(table([(1, text)])).first()
    assert [(s.start, s.end) for s in row[kind]] == found


def test_context_lifts_the_score(table):
    rows = personal_data(table([(1, "call me: +1 988 555 2485"), (2, "abcdefg: +1 988 555 2485")])).orderBy("id").collect()
    assert rows[0].phone[0].score > rows[1].phone[0].score


def test_lines_plan_and_empty(spark, table):
    df = personal_data(table([(1, "a@b.c 1.2.3.4 d@e.f")]))
    assert df.select(as_line(df["email"])).first()[0] == "email:0:5,email:14:19"
    plan = plan_of(df)
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert personal_data(table([])).collect() == []
    assert [k.name for k in KINDS if k.base] == list(BASE)


def test_very_many_matches(table):
    """A text of 40,000 matches takes seconds, and its last place is right."""
    row = personal_data(table([(1, "ü mail a@b.cc and " * 40_000)])).select("email").first()
    assert len(row.email) == 40_000 and (row.email[-1].start, row.email[-1].end) == (39_999 * 18 + 7, 39_999 * 18 + 13)


def test_context_reaches_over_earlier_matches(table):
    text = "ssn 123-45-6789, 223-45-6789, 323-45-6789, 423-45-6789, 523-45-6789"
    near = [m.start() for m in re.finditer("[0-9]{3}-", text) if "ssn" in text[max(0, m.start() - 48):m.start()]]
    assert [s.start for s in personal_data(table([(1, text)])).first().ssn] == near and len(near) == 4


def test_context_reaches_back_over_later_matches(table):
    text = "123-45-6789, 223-45-6789, 323-45-6789, 423-45-6789, 523-45-6789 ssn"
    near = [m.start() for m in re.finditer("[0-9]{3}-[0-9]{2}-[0-9]{4}", text) if "ssn" in text[m.end():m.end() + 48]]
    assert [s.start for s in personal_data(table([(1, text)])).first().ssn] == near and 1 < len(near) < 5
