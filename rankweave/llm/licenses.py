"""License scan by ordered signature rules.

A rule is a regex with a label, a priority, a confidence and the keywords one of which its
match must hold. One pass of an Aho-Corasick automaton over the lower-cased text finds the
keywords that are there, and only the rules they open are run. Overlapping detections are
settled by order: a detection inside the interval of one with a higher priority, or of one as
high and longer, is suppressed. The score of a text is the highest confidence left, lifted by
each further label.

The base phrases are found by words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z
lower-cased, a phrase wherever its words stand next to each other. Base labels are never
suppressed. A null or empty text has no words, no labels and the score 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.words import ALNUM, LOWER

#: fixed values: phrase -> label
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Licenses by name: label, SPDX identifiers, names as regexes over lower-cased text, a word each name holds.
# `~` stands for any run of blanks, hyphens and commas, also across line breaks and the comment leaders after them.
_NAMED = (
    ("mit", "mit|x11|mit-0", "mit~licen[cs]e|expat~licen[cs]e|x11~licen[cs]e", "licen"),
    ("apache-1", "apache-1.0|apache-1.1", "apache~(software~)?licen[cs]e~(version~|v)?1(\\.[01])?(?!\\d)", "apache"),
    ("apache-2", "apache-2.0", "apache~(software~)?licen[cs]e~(version~|v)?2(\\.0)?(?!\\d)|asl~2\\.0", "apache|asl"),
    ("apache", "", "apache~(software~)?licen[cs]e", "apache"),
    ("gpl-1", "gpl-1.0|gpl-1.0-only|gpl-1.0-or-later", "gnu~general~public~licen[cs]e~(version~|v)?1(?!\\d)|gpl~?v?1(?![\\d.]*\\d)", "gnu|gpl"),
    ("gpl-2", "gpl-2.0|gpl-2.0-only|gpl-2.0-or-later", "gnu~general~public~licen[cs]e~(version~|v)?2(?!\\d)|gpl~?v?2(?!\\d)", "gnu|gpl"),
    ("gpl-3", "gpl-3.0|gpl-3.0-only|gpl-3.0-or-later", "gnu~general~public~licen[cs]e~(version~|v)?3(?!\\d)|gpl~?v?3(?!\\d)", "gnu|gpl"),
    ("gpl", "", "gnu~general~public~licen[cs]e|gnu~gpl(?!\\w)", "gnu"),
    ("lgpl-2", "lgpl-2.0|lgpl-2.0-only", "gnu~(library|lesser)~general~public~licen[cs]e~(version~|v)?2(\\.0)?(?![\\d.]*\\d)", "gnu"),
    ("lgpl-2.1", "lgpl-2.1|lgpl-2.1-only|lgpl-2.1-or-later", "gnu~lesser~general~public~licen[cs]e~(version~|v)?2\\.1|lgpl~?v?2\\.1", "gnu|lgpl"),
    ("lgpl-3", "lgpl-3.0|lgpl-3.0-only|lgpl-3.0-or-later", "gnu~lesser~general~public~licen[cs]e~(version~|v)?3|lgpl~?v?3", "gnu|lgpl"),
    ("lgpl", "", "gnu~(library|lesser)~general~public~licen[cs]e|gnu~lgpl(?!\\w)", "gnu"),
    ("agpl-3", "agpl-3.0|agpl-3.0-only|agpl-3.0-or-later", "(gnu~)?affero~general~public~licen[cs]e~(version~|v)?3|agpl~?v?3", "affero|agpl"),
    ("agpl", "", "(gnu~)?affero~general~public~licen[cs]e", "affero"),
    ("gfdl", "gfdl-1.1|gfdl-1.2|gfdl-1.3", "gnu~free~documentation~licen[cs]e", "gnu"),
    ("bsd-2", "bsd-2-clause", "bsd~2~clause|(simplified|freebsd)~(bsd~)?licen[cs]e|(2|two)~clause~bsd", "bsd|simplified|freebsd"),
    ("bsd-3", "bsd-3-clause", "bsd~3~clause|(new|revised|modified)~bsd~licen[cs]e|(3|three)~clause~bsd", "bsd"),
    ("bsd-4", "bsd-4-clause", "bsd~4~clause|original~bsd~licen[cs]e|(4|four)~clause~bsd", "bsd"),
    ("bsd-0", "0bsd", "zero~clause~bsd|bsd~0~clause", "bsd"),
    ("bsd", "", "bsd~(style~)?licen[cs]e", "bsd"),
    ("isc", "isc", "isc~licen[cs]e", "licen"),
    ("mpl-1", "mpl-1.0|mpl-1.1", "mozilla~public~licen[cs]e~(version~|v)?1", "mozilla"),
    ("mpl-2", "mpl-2.0", "mozilla~public~licen[cs]e~(version~|v)?2|mpl~2\\.0", "mozilla|mpl"),
    ("mpl", "", "mozilla~public~licen[cs]e", "mozilla"),
    ("epl-1", "epl-1.0", "eclipse~public~licen[cs]e~(version~|v)?1", "eclipse"),
    ("epl-2", "epl-2.0", "eclipse~public~licen[cs]e~(version~|v)?2", "eclipse"),
    ("epl", "", "eclipse~public~licen[cs]e", "eclipse"),
    ("cddl", "cddl-1.0|cddl-1.1", "common~development~and~distribution~licen[cs]e", "distribution"),
    ("cpl", "cpl-1.0", "common~public~licen[cs]e", "common"),
    ("eupl", "eupl-1.0|eupl-1.1|eupl-1.2", "european~union~public~licen[cs]e", "european"),
    ("osl", "osl-1.0|osl-2.0|osl-2.1|osl-3.0", "open~software~licen[cs]e", "software"),
    ("afl", "afl-1.1|afl-2.0|afl-2.1|afl-3.0", "academic~free~licen[cs]e", "academic"),
    ("artistic-1", "artistic-1.0", "artistic~licen[cs]e~(version~|v)?1", "artistic"),
    ("artistic-2", "artistic-2.0", "artistic~licen[cs]e~(version~|v)?2", "artistic"),
    ("artistic", "", "artistic~licen[cs]e", "artistic"),
    ("bsl", "bsl-1.0", "boost~software~licen[cs]e", "boost"),
    ("busl", "busl-1.1", "business~source~licen[cs]e", "business"),
    ("sspl", "sspl-1.0", "server~side~public~licen[cs]e", "server"),
    ("elastic-2", "elastic-2.0", "elastic~licen[cs]e", "elastic"),
    ("unlicense", "unlicense", "the~unlicense(?!d)", "unlicense"),
    ("wtfpl", "wtfpl", "do~what~the~\\w+~you~want~to~public~licen[cs]e|wtfpl", "want|wtfpl"),
    ("zlib", "zlib", "zlib(/libpng)?~licen[cs]e", "zlib"),
    ("libpng", "libpng|libpng-2.0", "libpng~licen[cs]e", "libpng"),
    ("openssl", "openssl", "openssl~licen[cs]e", "openssl"),
    ("python", "psf-2.0|python-2.0", "python~software~foundation~licen[cs]e|psf~licen[cs]e", "python|psf"),
    ("php", "php-3.0|php-3.01", "php~licen[cs]e", "php"),
    ("ruby", "ruby", "ruby~licen[cs]e", "ruby"),
    ("ncsa", "ncsa", "(university~of~illinois|uiuc|ncsa)~(open~source~)?licen[cs]e", "illinois|uiuc|ncsa"),
    ("postgresql", "postgresql", "postgresql~licen[cs]e", "postgresql"),
    ("w3c", "w3c", "w3c~software(~notice~and)?~licen[cs]e", "w3c"),
    ("ofl", "ofl-1.0|ofl-1.1", "sil~open~font~licen[cs]e", "font"),
    ("upl", "upl-1.0", "universal~permissive~licen[cs]e", "permissive"),
    ("ms-pl", "ms-pl", "microsoft~public~licen[cs]e", "microsoft"),
    ("ms-rl", "ms-rl", "microsoft~reciprocal~licen[cs]e", "microsoft"),
    ("vim", "vim", "vim~licen[cs]e", "licen"),
    ("unicode", "unicode-dfs-2015|unicode-dfs-2016|unicode-3.0", "unicode~(terms~of~use|licen[cs]e)", "unicode"),
    ("odbl", "odbl-1.0", "open~(data~commons~open~)?database~licen[cs]e", "database"),
    ("odc-by", "odc-by-1.0", "open~data~commons~attribution~licen[cs]e", "commons"),
    ("pddl", "pddl-1.0", "(open~data~commons~)?public~domain~dedication~and~licen[cs]e", "dedication"),
    ("mulan", "mulanpsl-1.0|mulanpsl-2.0", "mulan~(permissive~software|psl)", "mulan"),
    ("cecill", "cecill-1.0|cecill-2.0|cecill-2.1|cecill-b|cecill-c", "cecill(~[bc])?~(free~software~)?licen[cs]e", "cecill"),
    ("openrail", "", "open~?rail(~?[mads]+)?~licen[cs]e|responsible~ai~licen[cs]e", "rail|responsible"),
    ("llama", "", "llama~\\d?(\\.\\d)?~?community~licen[cs]e", "llama"),
    ("proprietary", "", "all~rights~reserved|proprietary~and~confidential", "reserved|proprietary"),
    ("public-domain", "cc-pddc", "(released|placed|dedicated)~(in)?to~the~public~domain", "domain"),
)
# Creative Commons licenses come from their parts.
_PARTS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
_SPOKEN = {"by": "attribution", "sa": "share~?alike", "nd": "no~?deriv(ative)?s(~works)?", "nc": "non~?commercial"}
_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


@dataclass(frozen=True)
class Rule:
    label: str
    regex: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float


def _blank(regex: str) -> str:
    # possessive, and no name goes on with a character of a run, so a run is read once
    run = r"(?:\n[ \t]*+(?:[*#]++|//++)|[\s,-])"
    return regex.replace("~?", f"{run}*+").replace("~", f"{run}++")


def _rules() -> list[Rule]:
    """All rules, in order of priority: identifiers, addresses, grants, full names."""
    out: list[Rule] = []
    lead = "(?:(?:re)?licen[sc]ed|distributed|released|available|provided|published)~(?:under|by|with)~(?:the~(?:terms~of~)?)?(?:the~)?"
    names: list[tuple[str, str, str, str]] = list(_NAMED)
    for parts in _PARTS:
        spoken = "~".join(_SPOKEN[p] for p in parts.split("-"))
        symbols = "~".join(parts.split("-"))
        names.append((f"cc-{parts}", "|".join(f"cc-{parts}-{v}" for v in _VERSIONS),
                      f"cc~{symbols}(?![\\s-]{{0,2}}(?:sa|nd|nc)(?!\\w))|creative~commons~{spoken}(?!~(?:share|no|non))", "cc|creative"))
    names.append(("cc0", "cc0-1.0", "cc0|creative~commons~zero", "cc0|creative"))
    for label, identifiers, regex, words in names:
        held = tuple(words.split("|"))
        if identifiers:
            one = "|".join(re.escape(x) for x in identifiers.split("|"))
            out.append(Rule(label, f"spdx-license-identifier:\\s*+(?:{one})(?![\\w.-]*\\w)", ("spdx",), 4, 1.0))
            out.append(Rule(label, f"(?:spdx|opensource)\\.org/licenses/(?:{one})(?![\\w.-]*\\w)", ("/licenses/",), 3, 0.95))
        out.append(Rule(label, _blank(f"{lead}(?:{regex})"), held, 2, 0.9))
        out.append(Rule(label, _blank(f"(?<!\\w)(?:{regex})"), held, 1, 0.7))
    for parts in _PARTS:
        out.append(Rule(f"cc-{parts}", f"creativecommons\\.org/licenses/{parts}/", ("creativecommons",), 3, 0.95))
    out.append(Rule("cc0", "creativecommons\\.org/publicdomain/zero/", ("creativecommons",), 3, 0.95))
    out += [Rule(label, _blank(regex), (word,), 3, 0.9) for label, regex, word in (
        ("mit", "permission~is~hereby~granted~free~of~charge~to~any~person~obtaining~a~copy", "hereby"),
        ("isc", "permission~to~use~copy~modify~and/or~distribute~this~software~for~any~purpose", "permission"),
        ("bsd", "redistribution~and~use~in~source~and~binary~forms", "redistribution"),
        ("apache-2", "apache\\.org/licenses/license-2\\.0", "apache.org"),
        ("gpl", "gnu\\.org/licenses/gpl", "gnu.org"),
        ("lgpl", "gnu\\.org/licenses/lgpl", "gnu.org"),
        ("agpl", "gnu\\.org/licenses/agpl", "gnu.org"),
        ("mpl-2", "mozilla\\.org/mpl/2\\.0", "mozilla.org"),
        ("unlicense", "this~is~free~and~unencumbered~software~released~into~the~public~domain", "unencumbered"),
        ("zlib", "provided~'?as-?is'?~without~any~express~or~implied~warranty", "implied"),
        ("bsl", "permission~is~hereby~granted~free~of~charge~to~any~person~or~organization", "hereby"),
    )]
    return sorted(out, key=lambda r: -r.priority)


@lru_cache(maxsize=1)
def compiled() -> tuple[list[tuple[Rule, re.Pattern]], ahocorasick.Automaton]:
    """The rules with their regexes, and the automaton of all keywords, once per process."""
    rules = [(rule, re.compile(rule.regex)) for rule in _rules()]
    automaton = ahocorasick.Automaton()
    for word in {w for rule, _ in rules for w in rule.keywords}:
        automaton.add_word(word, word)
    automaton.make_automaton()
    return rules, automaton


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    label: str
    priority: int
    confidence: float


def detections(text: str) -> list[Detection]:
    """What is left after suppression, in order of place. `text` has A-Z lower-cased."""
    rules, automaton = compiled()
    there = {word for _, word in automaton.iter(text)}
    found = [Detection(m.start(), m.end(), rule.label, rule.priority, rule.confidence)
             for rule, regex in rules if not there.isdisjoint(rule.keywords) for m in regex.finditer(text)]
    # what may hold a detection comes before it; the sweep keeps the intervals that are open
    found.sort(key=lambda d: (d.start, -d.end, -d.priority, d.label))
    kept: list[Detection] = []
    open_: list[Detection] = []
    for one in found:
        open_ = [o for o in open_ if o.end > one.start]
        inside = [o for o in open_ if o.end >= one.end]
        if any((o.priority, o.end - o.start) > (one.priority, one.end - one.start) or
               (o.label == one.label and o.priority >= one.priority) for o in inside):
            continue
        open_.append(one)
        kept.append(one)
    return kept


_TO_LINE = bytes(LOWER[k] if ALNUM[LOWER[k]] else 32 for k in range(256))


def base_places(text: bytes) -> tuple[int, list[tuple[int, str]]]:
    """(number of words, sorted (first word, label) of every base phrase)."""
    words = text.translate(_TO_LINE).split(b" ")
    words = [w for w in words if w]
    line, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in BASE.items():
        asked = b" " + phrase.encode() + b" "
        at, last, word = line.find(asked), 0, 0
        while at >= 0:
            word += line.count(b" ", last, at)
            found.append((word, label))
            at, last = line.find(asked, at + 1), at
    return len(words), sorted(found)


_ASCII_LOWER = {k: k + 32 for k in range(65, 91)}
_RESULT = ("id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           "score double, spans array<struct<start:long,end:long,label:string,confidence:double>>")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()),
                               ("confidence", pa.float64())]))
    for batch in batches:
        rows: list[tuple] = []
        for value in batch.column(1):
            text = value.as_py() or ""
            n_words, base = base_places(text.encode())
            spans = detections(text.translate(_ASCII_LOWER))
            mine = sorted({label for _, label in base})
            labels = sorted({d.label for d in spans} | set(mine))
            best = max([d.confidence for d in spans] + [0.9] * bool(base), default=0.0)
            score = 1 - (1 - best) * 0.5 ** max(0, len(labels) - 1)
            rows.append((n_words, len(base), base[0][0] if base else None, base[-1][0] if base else None,
                         ",".join(mine), ",".join(labels), score,
                         [{"start": d.start, "end": d.end, "label": d.label, "confidence": d.confidence} for d in spans]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[
            "id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: word and base counts, labels, score, and the spans of all detections left.

    Spans are in characters, ends exclusive.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_scan, _RESULT.replace("id string", f"id {rows.schema['id'].dataType.simpleString()}"))
