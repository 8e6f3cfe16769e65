"""Personal data: regexes propose spans, checksums confirm them, context words adjust the score.

All of it is column functions over the row's own text; nothing is shuffled. A regex gives the
matches and, by splitting, the lengths of what stands between them, and their running sum is
the place of each match in characters, ends exclusive. Running sums are taken by doubling, so
a text with very many matches costs little more than its length. Quantifiers are possessive and a match
begins only where no character of its first class precedes it or where the last match ended,
which leaves the leftmost non-overlapping matches as they are and makes every scan linear.

Base kinds (email, ip, card, phone) are kept whenever their own check passes. The other kinds,
iban (ISO 7064 mod 97-10) and ssn (a pattern that needs a context word), are kept from a score
of `THRESHOLD`. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
#: characters on either side of a span in which a context word counts
NEAR = 48
LIFT = 0.2

def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check."""
    def step(state: Column, char: Column) -> Column:
        digit = char.cast("int") * (F.lit(1) + state["odd"])
        return F.struct((F.lit(1) - state["odd"]).alias("odd"),
                        (state["sum"] + F.when(digit > 9, digit - 9).otherwise(digit)).alias("sum"))

    digits = F.filter(F.split(F.reverse(_digits(hit)), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("odd"), F.lit(0).alias("sum"))
    passes = F.aggregate(digits, start, step, lambda s: s["sum"] % 10 == 0)
    return F.when(F.length(_digits(hit)).between(13, 19), passes).otherwise(F.lit(False))


def _mod97(hit: Column) -> Column:
    """Whether country, check digits and account give a remainder of one."""
    def step(state: Column, char: Column) -> Column:
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), char) - 1
        return (state * F.when(value > 9, 100).otherwise(10) + value) % 97

    line = F.replace(hit, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(line, F.lit(5)), F.substr(line, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    rest = F.aggregate(F.transform(chars, lambda c: c), F.lit(0), lambda s, c: step(s, c).cast("int"))
    return F.length(line).between(15, 34) & (rest == 1)


_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)"


@dataclass(frozen=True)
class Kind:
    """`gate` is a cheap condition without which a text has no match."""
    name: str
    regex: str
    gate: Callable[[Column], Column]
    passes: Callable[[Column], Column]
    base: bool
    score: float
    context: str


KINDS = (
    # fixed values: the four base patterns, written so that they never scan a character twice
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: F.contains(t, F.lit("@")), lambda h: F.lit(True), True, 0.7, "mail|contact|write to"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
         lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda h: h.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), True, 0.6,
         "ip|address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++",
         lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), _luhn, True, 0.7, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda t: F.contains(t, F.lit("+")), lambda h: F.length(_digits(h)).between(9, 15), True, 0.6,
         "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), _mod97, False, 0.7, "iban|account|bank|konto"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda h: ~h.rlike("^(?:000|666|9..)-|-00-|-0000$"), False,
         0.35, "ssn|social security|tax"),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, kind: str, both: Callable[[Column, Column], Column], reach: int = 1 << 30) -> Column:
    """Each element joined to all before it by the associative `both`, in doubling steps of at most `reach`.

    A text of n matches costs n log n, where a fold that appends to an array would cost n squared.
    """
    def doubled(line: Column, step: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(None).cast(kind), step), line)
        return F.zip_with(F.slice(moved, F.lit(1), F.size(line)), line,
                          lambda a, b: F.when(a.isNull(), b).otherwise(both(a, b)))

    steps = F.array(*(F.lit(1 << k) for k in range(reach.bit_length())))
    return _let(values, lambda line: F.aggregate(F.filter(steps, lambda s: s < F.size(line)), line, doubled))


def places(text: Column, regex: str) -> Column:
    """All matches with their places: array of (start, end, hit, before, after), the last two `NEAR` characters."""
    def last(line: Column) -> Column:
        return F.substring(line, -NEAR, NEAR)

    def first(line: Column) -> Column:
        return F.substring(line, 1, NEAR)

    def spans(found: Column) -> Column:
        hits = found["hits"]
        gaps = F.slice(found["gaps"], F.lit(1), F.size(hits))
        earlier = F.slice(F.concat(F.array(F.lit("")), hits), F.lit(1), F.size(hits))
        ends = running(F.zip_with(gaps, hits, lambda gap, hit: (F.length(gap) + F.length(hit)).cast("bigint")),
                       "bigint", lambda a, b: a + b)
        before = running(F.zip_with(earlier, gaps, lambda hit, gap: last(F.concat(hit, gap))),
                         "string", lambda a, b: last(F.concat(a, b)), NEAR)
        later = F.slice(F.concat(hits, F.array(F.lit(""))), F.lit(2), F.size(hits))
        behind = F.slice(found["gaps"], F.lit(2), F.size(hits))
        # the same running form from the end of the text
        after = F.reverse(running(F.reverse(F.zip_with(behind, later, lambda gap, hit: first(F.concat(gap, hit)))),
                                  "string", lambda a, b: first(F.concat(b, a)), NEAR))
        at = F.zip_with(ends, hits, lambda end, hit: F.struct(
            (end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit")))
        near = F.zip_with(before, after, lambda b, a: F.struct(b.alias("before"), a.alias("after")))
        return F.zip_with(at, near, lambda s, n: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"),
            n["before"].alias("before"), n["after"].alias("after")))

    pieces = F.struct(F.split(text, regex, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hits"))
    return _let(pieces, spans)


def _scored(text: Column, kind: Kind) -> Column:
    found = F.filter(places(text, kind.regex), lambda s: kind.passes(s["hit"]))

    def score(span: Column) -> Column:
        context = F.lower(span["before"]).rlike(kind.context) | F.lower(span["after"]).rlike(kind.context)
        lift = F.when(context, LIFT).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
                        (F.lit(kind.score) + lift).alias("score"))

    found = F.transform(found, score)
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= THRESHOLD)
    empty = F.from_json(F.lit("[]"), "array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return F.when(kind.gate(text), found).otherwise(empty)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one array of (kind, start, end, score) for each kind) of every row of `docs`."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", *(_scored(F.col("text"), kind).alias(kind.name) for kind in KINDS))


def as_line(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
