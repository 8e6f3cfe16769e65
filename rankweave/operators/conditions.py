"""Search conditions: parsed, analysed, and counted in one text.

A condition is made of bare words, quoted phrases, `word*` prefixes and NEAR(a, b, n), joined by
AND, OR and NOT and grouped by parentheses. AND binds closer than OR, and neighbours without a
connector mean OR. A conjunction needs at least one part without NOT; one of NOTs alone finds
nothing. Parentheses that do not match are closed at the end, or ignored.

NEAR(a, b, n) finds places where all its terms (words, prefixes or phrases) stand in any order in
one field with at most n other words between them; without n they may stand anywhere in the
field. It occurs at each place where one of its terms begins such a stretch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.text import STOP_WORDS, WORD_BREAK, words

TOKEN = re.compile(r'"[^"]*"\*?|[()]|[^\s"()]+')
#: words between the terms of a NEAR that names no number
ANYWHERE = 1 << 30

# A tree is a list of groups, of which any may hold. A group is a list of (negated, part), which
# must all hold; a part is the number of a leaf or a tree.
Tree = list


@dataclass
class _Frame:
    """One level of parentheses: its groups, and the last two words that came before."""

    groups: list
    before: list[str]

    def add(self, part) -> None:
        negated = self.before[-1:] == ["NOT"]
        joined = (self.before[-2:-1] if negated else self.before[-1:]) == ["AND"]
        if joined and self.groups:
            self.groups[-1].append((negated, part))
        else:
            self.groups.append([(negated, part)])
        self.before.append("")


def parse(text: str) -> tuple[Tree, list[tuple[list[str], int | None]]]:
    """(tree, leaves); a leaf is (texts of its terms, n of a NEAR or None for a plain leaf)."""
    tokens = TOKEN.findall(text or "")
    frames, leaves, i = [_Frame([], [])], [], 0
    while i < len(tokens):
        token, frame = tokens[i], frames[-1]
        word = token.upper()
        i += 1
        if word == "NEAR" and tokens[i:i + 1] == ["("]:
            terms, reach, i = _near(tokens, i + 1)
            if terms:
                frame.add(len(leaves))
                leaves.append((terms, reach))
        elif word in ("AND", "OR", "NOT"):
            frame.before.append(word)
        elif token == "(":
            frames.append(_Frame([], []))
        elif token == ")":
            if len(frames) > 1:
                _close(frames)
        else:
            frame.add(len(leaves))
            leaves.append(([token], None))
    while len(frames) > 1:
        _close(frames)
    return frames[0].groups, leaves


def _close(frames: list[_Frame]) -> None:
    groups = frames.pop().groups
    if len(groups) == 1 and len(groups[0]) == 1 and not groups[0][0][0]:
        frames[-1].add(groups[0][0][1])
    elif groups:
        frames[-1].add(groups)


def _near(tokens: list[str], i: int) -> tuple[list[str], int, int]:
    """Terms and n of a NEAR whose parenthesis has just been opened, and the place behind it."""
    depth, terms, closed = 1, [], 0
    while i < len(tokens) and depth:
        token = tokens[i]
        i += 1
        if token == "(":
            depth += 1
        elif token == ")":
            depth -= 1
            closed = closed or len(terms)
        else:
            terms += [token] if token.startswith('"') else [t for t in token.split(",") if t]
    reach = ANYWHERE
    if len(terms) > 1 and (terms[-1].isascii() and terms[-1].isdigit() or terms[-1].upper() == "MAX"):
        last = terms.pop()
        reach = min(int(last), ANYWHERE) if last.isdigit() else ANYWHERE
    return terms, reach, i


def pruned(tree: Tree, number: dict[int, int]) -> Tree:
    """The tree over the leaves that have a new number; others hold no indexed word and drop out."""
    groups = []
    for group in tree:
        parts = []
        for negated, part in group:
            if isinstance(part, int):
                if part in number:
                    parts.append((bool(negated), number[part]))
            elif inner := pruned(part, number):
                parts.append((bool(negated), inner))
        if parts:
            groups.append(parts)
    return groups


def counting(tree: Tree) -> set[int]:
    """The leaves below no NOT: those that add to the score."""
    return {leaf for group in tree for negated, part in group if not negated
            for leaf in ([part] if isinstance(part, int) else counting(part))}


def named_leaves(tree: Tree) -> set[int]:
    """All leaves of a tree."""
    return {leaf for group in tree for _, part in group for leaf in ([part] if isinstance(part, int) else named_leaves(part))}


def met(tree: Tree, holds: Callable, false):
    """Whether the tree holds, in what `holds(leaf)` returns: Columns or arrays of booleans."""
    result = false
    for group in tree:
        if all(negated for negated, _ in group):
            continue
        parts = [(negated, holds(part) if isinstance(part, int) else met(part, holds, false)) for negated, part in group]
        result = result | reduce(lambda a, b: a & b, [~value if negated else value for negated, value in parts])
    return result


def flat(tree: Tree) -> list[int] | None:
    """The leaves of a plain OR of leaves; None for any other tree."""
    if all(len(group) == 1 and not group[0][0] and isinstance(group[0][1], int) for group in tree):
        return [group[0][1] for group in tree]
    return None


# ---- analysis by Spark, the same for one condition and for a table of them ----


@dataclass(frozen=True)
class Term:
    """A word, prefix or phrase: (offset, word) of its indexed words, and how many words it spans."""

    words: tuple[tuple[int, str], ...]
    is_prefix: bool

    @property
    def base(self) -> int:
        return self.words[0][0]

    @property
    def width(self) -> int:
        """Words from the first to the last indexed one."""
        return self.words[-1][0] - self.base + 1


@dataclass(frozen=True)
class Leaf:
    """One leaf; `reach` is None unless it is a NEAR of several terms."""

    name: str
    terms: tuple[Term, ...]
    reach: int | None = None

    @property
    def window(self) -> int:
        """Words a NEAR may span."""
        return min(ANYWHERE, self.reach + sum(t.width for t in self.terms))

    @property
    def word(self) -> str | None:
        """The word of a leaf that is one whole word."""
        term = self.terms[0]
        return term.words[0][1] if len(self.terms) == 1 and len(term.words) == 1 and not term.is_prefix else None


def make_leaf(terms: Sequence[tuple[Sequence[str], bool]], reach: int | None, stop_words: Sequence[str] = STOP_WORDS
              ) -> Leaf | None:
    """A leaf from (words, is_prefix) of its terms; None if none of them holds an indexed word."""
    made, names = [], []
    for ws, is_prefix in terms:
        kept = tuple((i, w) for i, w in enumerate(ws) if w not in stop_words)
        name = " ".join(ws) + "*" * is_prefix
        if kept and name not in names:
            made.append(Term(kept, bool(is_prefix)))
            names.append(name)
    if not made:
        return None
    if len(made) == 1:
        return Leaf(names[0], tuple(made))
    return Leaf(f"NEAR({', '.join(names)}, {reach})", tuple(made), reach)


def _analysed(parts: Column) -> Column:
    """(ws, is_prefix) of each text of an array."""
    return F.transform(parts, lambda p: F.struct(words(p).alias("ws"), F.regexp_like(p, F.lit(r'\*"?$')).alias("is_prefix")))


TREES = "tree string, leaves array<struct<parts:array<string>,reach:int>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("parts", pa.list_(pa.string())), ("reach", pa.int32())]))
    for batch in batches:
        found = [parse(text) for text in batch.column(1).to_pylist()]
        leaves = [[{"parts": parts, "reach": reach} for parts, reach in leaves] for _, leaves in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(tree) for tree, _ in found], pa.string()),
                                          pa.array(leaves, kind)], names=["query_id", "tree", "leaves"])


def parsed(requests: DataFrame) -> DataFrame:
    """(query_id, tree, leaves) of (query_id, keyword_search); a leaf is (terms of (ws, is_prefix), reach)."""
    found = requests.select(F.col("query_id").cast("long").alias("query_id"), "keyword_search").mapInArrow(
        _parsed, f"query_id long, {TREES}")
    return found.select("query_id", "tree", F.transform("leaves", lambda leaf: F.struct(
        _analysed(leaf["parts"]).alias("terms"), leaf["reach"].alias("reach"))).alias("leaves"))


def parse_condition(spark: SparkSession, condition: str, stop_words: Sequence[str] = STOP_WORDS) -> tuple[Tree, list[Leaf]]:
    """(tree, leaves) of one condition, analysed by the same expressions as a table of them."""
    if not condition or not condition.strip():
        raise ValueError("keyword search text must not be blank")
    tree, raw = parse(condition)
    if not raw:
        return [], []
    texts = F.array(*[F.array(*[F.lit(p) for p in parts]) for parts, _ in raw])
    analysed = spark.sql("SELECT 1").select(F.transform(texts, _analysed).alias("a")).first()["a"]
    return numbered(tree, [(terms, reach) for terms, (_, reach) in zip(analysed, raw, strict=True)], stop_words)


def numbered(tree: Tree, raw: Sequence, stop_words: Sequence[str]) -> tuple[Tree, list[Leaf]]:
    """The tree over distinct leaves."""
    leaves: dict[str, tuple[int, Leaf]] = {}
    number = {}
    for i, (terms, reach) in enumerate(raw):
        if (leaf := make_leaf(terms, reach, stop_words)) is not None:
            number[i] = leaves.setdefault(leaf.name, (len(leaves), leaf))[0]
    return pruned(tree, number), [leaf for _, leaf in leaves.values()]


# ---- occurrences in one folded text, as patterns ----

_WORD = r"[\p{L}\p{N}]"


def _stop(stop_words: Sequence[str]) -> str:
    return rf"(?!(?:{'|'.join(stop_words)})(?!{_WORD}))" if stop_words else ""


def _spelled(term: Term, stop_words: Sequence[str], at: int) -> str:
    """Pattern of the words of a term from its word number `at`; a stop word inside matches any word."""
    by_offset = dict(term.words)
    pieces = []
    for offset in range(term.base + at, term.words[-1][0] + 1):
        word = by_offset.get(offset)
        if word is None:
            pieces.append(rf"{_WORD}++")
        elif term.is_prefix:
            pieces.append(rf"{_stop(stop_words)}{word}{_WORD}*+")
        else:
            pieces.append(rf"{word}(?!{_WORD})")
    return WORD_BREAK.join(pieces)


def pattern(leaf: Leaf, stop_words: Sequence[str] = STOP_WORDS) -> str:
    """A regular expression that matches once at each place where a leaf, no NEAR, occurs in a folded text.

    A leaf that begins with a whole word has its pattern begin with it, which the matcher
    looks for without trying every place.
    """
    term = leaf.terms[0]
    first, rest = term.words[0][1], _spelled(term, stop_words, 1)
    follows = f"(?={WORD_BREAK}{rest})" if rest else ""
    if term.is_prefix:
        return rf"(?<!{_WORD}){_stop(stop_words)}{first}{_WORD}*+{follows}"
    return rf"{first}(?<!{_WORD}{first})(?!{_WORD}){follows}"


def leaf_count(leaf: Leaf, folded_text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """How often a leaf, no NEAR, occurs in one folded text."""
    return F.regexp_count(folded_text, F.lit(pattern(leaf, stop_words)))


# ---- occurrences from places of words ----


def near_places(starts: Sequence[np.ndarray], widths: Sequence[int], window: int, segment: np.ndarray | None = None
                ) -> np.ndarray:
    """Places where a NEAR occurs, from the sorted places where each of its terms starts.

    With `segment`, places are indexes of words and a stretch stays within one segment.
    """
    if any(not len(s) for s in starts):
        return np.zeros(0, np.int64)
    found = []
    for k, own in enumerate(starts):
        good = np.ones(len(own), bool)
        for u, other in enumerate(starts):
            if u == k:
                continue
            at = np.searchsorted(other, own, side="right")       # the next one behind
            there = at < len(other)
            nearest = other[np.minimum(at, len(other) - 1)]
            good &= there & (nearest + widths[u] <= own + window)
            if segment is not None:
                good &= segment[nearest] == segment[own]
        found.append(own[good])
    return np.unique(np.concatenate(found))



# ---- leaves as rows, for a join with postings ----

LEAF_TERMS = ("leaf string, sub int, idx int, term string, is_prefix boolean, n_terms int, window int, widths array<int>")


def leaf_terms(requests: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """A row for each indexed word of each distinct leaf.

    `sub` is the term of the leaf, `idx` the offset of the word from the first one of its term,
    `n_terms` the number of words of the term. `window` is null unless the leaf is a NEAR.
    """
    stop_words = tuple(stop_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves: dict[str, Leaf] = {}
            for raw in batch.column(0).to_pylist():
                for one in raw:
                    leaf = make_leaf([(t["ws"], t["is_prefix"]) for t in one["terms"]], one["reach"], stop_words)
                    if leaf is not None:
                        leaves[leaf.name] = leaf
            rows = [(leaf.name, sub, offset - term.base, word, term.is_prefix, len(term.words),
                     None if leaf.reach is None else leaf.window, [t.width for t in leaf.terms])
                    for leaf in leaves.values() for sub, term in enumerate(leaf.terms) for offset, word in term.words]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["leaf", "sub", "idx", "term", "is_prefix", "n_terms", "window", "widths"])

    return parsed(requests).select("leaves").mapInArrow(scan, LEAF_TERMS).distinct()
