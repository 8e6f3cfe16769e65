"""Text expressions: case text, analyzer, keyword derivation, display strings."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """(from, to) of a translation of lower-cased text that takes accents off.

    By canonical decomposition: a lower-case Latin, Greek or Cyrillic letter that decomposes into
    a letter and combining marks becomes that letter, and combining marks by themselves are
    deleted. Final sigma counts as sigma. Letters without a decomposition (such as o with a
    stroke) stay.
    """
    letters = [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]
    marks = [*range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100), *range(0xFE20, 0xFE30)]
    pairs = [("ς", "σ")]
    for c in map(chr, letters):
        base, *rest = unicodedata.normalize("NFD", c)
        if rest and c == c.lower() and base.isalpha() and all(unicodedata.combining(m) for m in rest):
            pairs.append((c, base))
    alone = [c for c in map(chr, marks) if unicodedata.combining(c)]
    return "".join(c for c, _ in pairs) + "".join(alone), "".join(base for _, base in pairs)


FOLD_FROM, FOLD_TO = _folding()
# The English stop list.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is",
    "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there",
    "these", "they", "this", "to", "was", "will", "with",
)
WORD_BREAK = r"[^\p{L}\p{N}]+"

# The text embedded for each embedding type, as (label, field) pairs.
CASE_TEXT = {
    "FullCase": (
        ("Patient: ", "patient_age"), (" year old ", "gender"),
        (". Chief Complaint: ", "chief_complaint"), (". Symptoms: ", "symptoms"),
        (". Medical History: ", "medical_history"), (". Diagnosis: ", "diagnosis"),
        (". Treatment: ", "treatment_plan"), (". Outcome: ", "outcome"),
    ),
    "SymptomsOnly": (("Chief Complaint: ", "chief_complaint"), (". Symptoms: ", "symptoms")),
    "DiagnosisOnly": (("Diagnosis: ", "diagnosis"),),
    "TreatmentOnly": (("Treatment: ", "treatment_plan"),),
    "OutcomeOnly": (("Outcome: ", "outcome"),),
}


def compose_text(embedding_type: str) -> Column:
    """Text of a case for one embedding type; a null field counts as ''.

    The three single-field types give null for a blank field, so such rows can be skipped.
    """
    if embedding_type not in CASE_TEXT:
        raise ValueError(f"unknown embedding type: {embedding_type}")
    parts = CASE_TEXT[embedding_type]
    pieces = []
    for label, field in parts:
        pieces += [F.lit(label), F.coalesce(F.col(field).cast("string"), F.lit(""))]
    text = F.concat(*pieces)
    if len(parts) == 1:
        return F.when(F.trim(F.col(parts[0][1])) != "", text)
    return text


def folded(text: Column) -> Column:
    """Lower case without accents (`_folding`). ASCII text has none, and is not looked through for them."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO))


def words(text: Column) -> Column:
    """All words in order, stop words included: their index is the word position."""
    return F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def spaced_words(text: Column) -> Column:
    """The `words` of a text with one space between them."""
    return F.trim(F.regexp_replace(folded(F.coalesce(text, F.lit(""))), WORD_BREAK, " "))


def _quoted(stop_words: Sequence[str]) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in stop_words)


def is_kept(word: str, stop_words: Sequence[str] = STOP_WORDS) -> str:
    """SQL text: whether the named word is indexed, i.e. no stop word.

    As text the whole list reaches Spark in one call, and is looked up as a set.
    """
    return f"{word} NOT IN ({_quoted(stop_words)})" if stop_words else "true"


def kept_words(column: str, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The indexed words of a column of words."""
    return F.expr(f"filter(`{column}`, w -> {is_kept('w', stop_words)})")


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Indexed words of a text: lower-cased, accent-folded, stop words dropped."""
    if not stop_words:
        return words(text)
    # a list of literals is looked up as a set, an array is gone through for each word
    return F.filter(words(text), lambda w: ~w.isin(*stop_words))


def derive_keywords(text: Column, n: int = 3) -> Column:
    """First `n` whitespace-separated words joined by one space."""
    return F.array_join(F.slice(F.split(squeeze_ends(text), r"\s+"), 1, n), " ")


def squeeze_ends(text: Column) -> Column:
    """Strip leading and trailing whitespace of any kind (`trim` strips spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def truncated(text: Column, limit: int) -> Column:
    """Text cut at `limit` characters with an ellipsis; null becomes ''."""
    text = F.coalesce(text, F.lit(""))
    cut = F.regexp_replace(F.substring(text, 1, limit), r"\s+$", "")
    return F.when(F.length(text) > limit, F.concat(cut, F.lit("…"))).otherwise(text)


def display_text(limit: int = 80) -> Column:
    return truncated(F.coalesce(F.col("patient_description"), F.col("keyword_search")), limit)


def display_user() -> Column:
    return F.coalesce(F.col("user_email"), F.concat(F.lit("user #"), F.col("user_id").cast("string")))


def display_score() -> Column:
    """Similarity, else fused score, to three places; a missing score shows as 0."""
    return F.round(F.coalesce(F.col("similarity"), F.col("hybrid_score"), F.lit(0.0)), 3)


def latency_label(ms: Column) -> Column:
    """'n ms' below a second, else seconds at two places, halves rounded up."""
    hundredths = F.floor((ms + 5) / 10)
    seconds = F.format_string("%d.%02d s", F.floor(hundredths / 100), F.pmod(hundredths, F.lit(100)))
    return (
        F.when(ms.isNull(), F.lit("—"))
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms")))
        .otherwise(seconds)
    )
