"""Secrets by pattern, and by novelty under a primed zstandard dictionary.

Base kinds are patterns: an assignment to a sensitive name, an access key, a long hex run.
The method adds `novel` spans: a string of at least `SHORTEST` token characters that
stands within `NEAR` characters of a sensitive word, before or after it. Its novelty is the number of
bytes it adds to the compressed text around it, where the compressor already knows a dictionary
of identifiers, as a share of what random strings of the same length and alphabet add to source
code (all but the cheapest tenth of them). Words of the dictionary, identifiers made of them and
repeats cost little; what costs as much as a random string is reported. Numbers (card numbers, dates, strings without a letter) are not
candidates. A novel span never overlaps a base span or another novel one.

Places are in characters, ends exclusive. A null text counts as empty.
"""

from __future__ import annotations

import importlib
import inspect
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed order of the kinds
KINDS = ("assign", "access", "hex", "novel")
SHORTEST = 16
NEAR = 40
#: characters on either side that the compressor sees
AROUND = 256
#: added bytes as a share of what a random string adds
NOVEL = 1.0
#: random strings that tell what one of a length and alphabet adds, and the greatest length tried
TRIALS, LONGEST_TRIAL = 40, 64

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")                      # runs are maximal, so shorter ones are simply not found
_NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")
_SENSITIVE = re.compile(r"(?ai)pass(?:word|wd|phrase)|secret|token|api[_ -]?key|credential|bearer|private[_ -]?key"
                        r"|access[_ -]?key|client[_ -]?id|auth(?:orization)?\b")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
_PART = re.compile(r"[A-Za-z0-9+/_=-]")
_LETTER = re.compile(r"[A-Za-z]")

# The dictionary: names of the standard library with the words they are made of, then every verb joined
# to every noun in the usual ways of writing identifiers. All workers need the same version of Python.
_MODULES = ("builtins os socket ast typing logging argparse subprocess unittest asyncio pathlib http.client email.message "
            "json collections threading urllib.request datetime decimal inspect itertools functools hashlib hmac csv "
            "configparser tarfile zipfile xml.dom.minidom xml.sax.handler").split()
_VERBS = "get set is has add new make load save read write open close find send parse build create delete update".split()
_NOUNS = ("user name value index count list file path data key type node item table config client server request "
          "response session message token password secret buffer string number error result event state").split()
_CLASSES = ("0123456789abcdef", string.digits, string.ascii_lowercase, string.ascii_uppercase, "+/_=-")
_LEVEL = 19


def _identifiers() -> set[str]:
    names = set()
    for module in map(importlib.import_module, _MODULES):
        for name, value in vars(module).items():
            names |= {name} | (set(vars(value)) if inspect.isclass(value) else set())
    return names


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    names = _identifiers()
    parts = {form for name in names for part in re.findall("[A-Z]?[a-z]{2,}|[A-Z]{3,}", name)
             for form in (part.lower(), part.title(), part.upper())}
    joined = [f"{v}_{n} {v}{n.title()} {n.upper()}_{v.upper()}" for n in _NOUNS for v in _VERBS]
    primer = zstandard.ZstdCompressionDict(" ".join([*sorted(parts), *sorted(names), *joined, ""]).encode(),
                                           dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primer.precompute_compress(level=_LEVEL)
    return zstandard.ZstdCompressor(level=_LEVEL, dict_data=primer, write_content_size=False, write_checksum=False)


def _added(around: bytes, mine: bytes) -> int:
    size = _compressor().compress
    return len(size(around + mine)) - len(size(around))


def alphabet(candidate: str) -> str:
    """The characters that a random string of the candidate's kind would be drawn from."""
    chars = set(candidate)
    if chars <= set(_CLASSES[0]):
        return _CLASSES[0]
    return "".join(c for c in _CLASSES[1:4] if chars & set(c)) + "".join(c for c in _CLASSES[4] if c in chars)


@lru_cache(maxsize=4096)
def random_cost(letters: str, length: int) -> float:
    """Bytes that all but a tenth of the random strings of this length and alphabet add to source code, by length."""
    draw, code = random.Random(f"{letters}:{length}"), inspect.getsource(random.Random)
    costs = []
    for _ in range(TRIALS):
        at = draw.randrange(len(code) - 2 * AROUND)
        mine = "".join(draw.choices(letters, k=length))
        costs.append(_added(code[at:at + 2 * AROUND].encode(), mine.encode()) / length)
    return sorted(costs)[TRIALS // 10]


def novelty(before: str, candidate: str, after: str) -> float:
    """Compressed bytes that the candidate adds to its surroundings, as a share of a random string's."""
    added = _added((before + after).encode(), candidate.encode()) / len(candidate)
    return added / random_cost(alphabet(candidate), min(len(candidate), LONGEST_TRIAL))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds, each leftmost and non-overlapping, in order of start and kind."""
    out = []
    low = text.lower()
    if any(word in low for word in _NAMED):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Strings near a sensitive word in order; one that holds such a word is cut there."""
    words = [word.span() for word in _SENSITIVE.finditer(text)]
    after, past = [], 0
    for _, at in words:
        stop = min(at + NEAR, len(text))
        at = max(at, past)
        while at < stop:
            token = _TOKEN.search(text, at, min(stop + SHORTEST, len(text)))
            if not token or token.start() >= stop:
                break
            end = token.end()
            while end < len(text) and _PART.match(text, end):
                end += 1
            after.append((token.start(), end))
            at = past = end
    starts, ends, before = [a for a, _ in words], [b for _, b in after], []
    for token in _TOKEN.finditer(text) if words else ():
        k = bisect_left(starts, token.start())
        if k == len(starts):
            break
        start, end = token.start(), min(token.end(), starts[k])
        j = bisect_right(ends, start)
        if end - start >= SHORTEST and starts[k] - end < NEAR and (j == len(after) or after[j][0] >= end):
            before.append((start, end))
    return sorted(after + before)


def novel_spans(text: str, base: list[tuple[str, int, int]], least: float = NOVEL) -> list[tuple[str, int, int]]:
    """Incompressible strings near a sensitive word that no base span touches."""
    out, k, reach = [], 0, 0
    for start, end in candidates(text):
        while k < len(base) and base[k][1] < end:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= start and _LETTER.search(text, start, end) and novelty(text[max(0, start - AROUND):start], text[start:end], text[end:end + AROUND]) >= least:
            out.append(("novel", start, end))
    return out


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans in order of start and kind."""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(text.as_py() or "")] for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "spans"])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans of (kind, start, end) in order of start and kind) of every row of `docs`."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scan, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
