"""Token counts of whole texts under a byte-level BPE vocabulary, by the whole-token shortcut.

Which strings of the vocabulary encode alone as one token is proved once, on the driver: the
merges are applied to each of them, and those that end as one piece become a table. Tasks
split texts into pre-tokens, look each one up in that table and count 1 where it is there.
Only the rest is merged. A task remembers what it has merged lately, a bounded number of strings.

The vocabulary is a `tokenizers` file of byte-level BPE; its size, fixed by that file, bounds
what is broadcast. Pre-tokens are cut by the pattern such files imply. Code points that this
Python's Unicode tables do not know may belong to another class in the tables of the library;
a stretch of text that holds one is cut by the library's own pre-tokenizer instead.

Null texts count as empty: no bytes, no tokens. Each row is counted by itself, so repeated
ids and null ids are kept as they are; further columns are not looked at. Long texts are read
in pieces that end where a pre-token surely ends. An unbroken run is one piece, whatever its
length, and is merged with a heap in n log n.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how byte-level BPE files with `use_regex` split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: code points of a text looked at together
PIECE = 1 << 18
#: letters of a pre-token that is merged by looking through all its pairs each time
SHORT = 64
#: pre-tokens whose merged length a task remembers
REMEMBERED = 1 << 18


@cache
def byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(spare)) for b in range(256))


@dataclass(frozen=True)
class Vocabulary:
    """What counting needs of a tokenizer file: `whole` encode alone as one token."""

    merges: dict[tuple[str, str], int]
    whole: frozenset[str]
    specials: tuple[str, ...]
    source: str

    def length(self, letters: str) -> int:
        """Tokens of one pre-token, given in byte letters."""
        return merged_length(letters, self.merges)


def merged_length(letters: str, merges: dict[tuple[str, str], int]) -> int:
    """How many pieces are left after all merges, lowest rank first, leftmost first."""
    if len(letters) > SHORT:
        return _merged_by_heap(letters, merges)
    parts, get, never = list(letters), merges.get, len(merges)
    ranks = [get(pair, never) for pair in zip(parts, parts[1:], strict=False)]
    while ranks:
        least = min(ranks)
        if least == never:
            break
        i = ranks.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del ranks[i]
        if i < len(ranks):
            ranks[i] = get((parts[i], parts[i + 1]), never)
        if i:
            ranks[i - 1] = get((parts[i - 1], parts[i]), never)
    return len(parts)


def _merged_by_heap(letters: str, merges: dict[tuple[str, str], int]) -> int:
    """The same in n log n."""
    n = len(letters)
    parts: list[str | None] = list(letters)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, parts[i], parts[i + 1]) for i in range(n - 1)
            if (rank := merges.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:     # one of the two was merged meanwhile
            continue
        parts[i], parts[j] = a + b, None
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := merges.get((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (rank := merges.get((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (rank, h, parts[h], parts[i]))
    return left


def read_vocabulary(path: str) -> Vocabulary:
    """Read a `tokenizers` file of byte-level BPE and prove which of its strings are whole tokens."""
    with open(path, encoding="utf-8") as file:
        source = file.read()
    parsed = json.loads(source)
    model, split = parsed["model"], parsed["pre_tokenizer"] or {}
    odd = [a["content"] for a in parsed["added_tokens"] if a["single_word"] or a["lstrip"] or a["rstrip"]]
    if (model["type"], split.get("type"), parsed["normalizer"]) != ("BPE", "ByteLevel", None) or odd:
        raise ValueError(f"not a plain byte-level BPE file: {path}")
    if split["add_prefix_space"] or not split.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError(f"a byte-level BPE file with settings that are not supported: {path}")
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    merges = {pair: rank for rank, pair in reversed(list(enumerate(pairs)))}
    whole = frozenset(s for s in model["vocab"] if merged_length(s, merges) == 1)
    # the longest first, as the library prefers it where two special strings start together
    specials = tuple(sorted((a["content"] for a in parsed["added_tokens"]), key=lambda s: (-len(s), s)))
    return Vocabulary(merges, whole, specials, source)


class Counter:
    """Counts the tokens of texts in one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.findall = regex.compile(PATTERN).findall
        self.border = regex.compile(r"\S(?=\s)")
        self.special = re.compile("|".join(map(re.escape, vocabulary.specials))) if vocabulary.specials else None
        self.seen: set[str] = set()                      # code points that Unicode here knows
        self.to_letters = {b: c for b, c in enumerate(byte_letters())}
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        # the table by the text it stands for; strings that are no whole UTF-8 are no pre-tokens
        self.known: dict[str, int] = {}
        for letters in vocabulary.whole:
            try:
                self.known[bytes(to_byte[c] for c in letters).decode("utf-8")] = 1
            except (KeyError, UnicodeDecodeError):
                continue
        self.proved = dict(self.known)
        self.library = None

    def pre_tokens(self, piece: str) -> list[str]:
        if piece.isascii():
            return self.findall(piece)
        new = {c for c in set(piece) - self.seen if unicodedata.category(c) != "Cn"}
        self.seen |= new
        if self.seen.issuperset(piece):
            return self.findall(piece)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.vocabulary.source).pre_tokenizer
        return [piece[a:b] for _, (a, b) in self.library.pre_tokenize_str(piece)]

    def merged(self, pre_token: str) -> int:
        letters = pre_token.encode("utf-8").decode("latin-1").translate(self.to_letters)
        n = self.vocabulary.length(letters)
        if len(self.known) >= len(self.proved) + REMEMBERED:      # start again: what is common comes back at once
            self.known.clear()
            self.known.update(self.proved)
        if len(pre_token) < 256:
            self.known[pre_token] = n
        return n

    def stretch(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total, lo, known = 0, 0, self.known
        while lo < len(text):
            cut = self.border.search(text, lo + PIECE - 1) if lo + PIECE < len(text) else None
            hi = cut.end() if cut else len(text)
            for pre_token in self.pre_tokens(text[lo:hi]):
                n = known.get(pre_token)
                total += n if n is not None else self.merged(pre_token)
            lo = hi
        return total

    def count(self, text: str) -> int:
        if self.special is None:
            return self.stretch(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.stretch, parts))


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row: UTF-8 bytes and tokens of the whole text.

    Special strings inside a text count as one token each. Nothing shuffles.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(shared.value)
            texts = batch.column(1)
            counts = [counter.count(text.as_py() or "") for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(scan, f"id {kind}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
