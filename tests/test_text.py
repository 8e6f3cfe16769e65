import pytest
from pyspark.sql import functions as F

from rankweave.functions.text import (
    compose_text, derive_keywords, display_text, display_user, folded, latency_label, tokens, words,
)


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize("text, want", [
    ("Dyspnée, at REST!", ["dyspnee", "at", "rest"]),
    ("  'a-b' c3 ", ["a", "b", "c3"]),
    ("", []), (None, []), ("…", []),
])
def test_words(spark, text, want):
    assert one(spark, text, "string", words) == want


def test_tokens_drop_stop_words(spark):
    assert one(spark, "the shortness of breath", "string", tokens) == ["shortness", "breath"]
    assert one(spark, "of a b", "string", lambda c: tokens(c, [])) == ["of", "a", "b"]


def test_compose_text_treats_null_as_empty(cases):
    got = {r[0]: r[1] for r in cases.select("case_id", compose_text("FullCase")).collect()}
    assert got[12] == ("Patient: 47 year old M. Chief Complaint: Dull chest pain. Symptoms: chest ache, cough. "
                       "Medical History: . Diagnosis: Muscle strain. Treatment: heat pack. Outcome: ")
    short = {r[0]: r[1] for r in cases.select("case_id", compose_text("SymptomsOnly")).collect()}
    assert short[26] == "Chief Complaint: Morning headache. Symptoms: vomiting"


def test_single_field_types_skip_blank(cases):
    got = {r[0]: r[1] for r in cases.select("case_id", compose_text("OutcomeOnly")).collect()}
    assert got == {12: None, 26: "Outcome: stable", 31: "Outcome: home", 32: None, 45: None}
    assert cases.where(compose_text("TreatmentOnly").isNull()).count() == 0
    with pytest.raises(ValueError):
        compose_text("ChiefComplaintOnly")


def test_derive_keywords(spark):
    assert one(spark, "  chest\tpain\n at night ", "string", derive_keywords) == "chest pain at"
    assert one(spark, "pain", "string", derive_keywords) == "pain"


@pytest.mark.parametrize("ms, want", [
    (None, "—"), (0, "0 ms"), (999, "999 ms"), (1000, "1.00 s"), (1234, "1.23 s"), (1235, "1.24 s"), (61999, "62.00 s"),
])
def test_latency_label(spark, ms, want):
    assert one(spark, ms, "long", latency_label) == want


def test_display_columns(spark):
    df = spark.createDataFrame(
        [(1, "a@x", "abcde fgh", None), (2, None, None, "kw"), (3, None, None, None)],
        "user_id long, user_email string, patient_description string, keyword_search string")
    got = df.select(display_user(), display_text(6)).collect()
    assert [tuple(r) for r in got] == [("a@x", "abcde…"), ("user #2", "kw"), ("user #3", "")]


def test_accents_of_three_scripts(spark):
    given = {"Việt Nam đường": "viet nam đuong", "ΆΈΉΊΌΎΏ Ὀδυσσεύς ΟΔΟΣ": "αεηιουω οδυσσευσ οδοσ", "Ёлка й Ў": "елка и у",
             "İstanbul Şişli Ǎ ő ů ř": "istanbul sisli a o u r", "e\u0301 o\u0308\u0323": "e o", "ß ø æ ł 漢字 が": "ß ø æ ł 漢字 が",
             "plain ASCII": "plain ascii"}
    df = spark.createDataFrame([(k,) for k in given], "t string")
    assert {r[0]: r[1] for r in df.select("t", folded(F.col("t"))).collect()} == given
