from paperflow.operators import prompts, verification
from test_claims import EXAMPLE, FIRST, SECOND, SOURCE

import pytest

ROW = {"example": EXAMPLE, **SOURCE}
GOOD = {"claims": [FIRST, SECOND], "verdict": "supported"}


def refuse(row):
    raise verification.Refused("will not")


def test_two_passes(spark):
    answer = lambda a: lambda row: a
    assert [(o.verdict, o.passes) for o in verification.verify(spark, [ROW], answer(GOOD))] == [("supported", 1)]
    (veto,) = verification.verify(spark, [ROW], answer(GOOD), answer(GOOD | {"verdict": "unsupported"}))
    assert (veto.verdict, veto.failures, veto.passes) == ("unsupported", ["MODEL_VETO"], 2)
    (kept,) = verification.verify(spark, [ROW], answer(GOOD), refuse)
    assert (kept.verdict, kept.passes, kept.notes) == ("supported", 1, ["second pass: will not"])
    none, odd = verification.verify(spark, [ROW, ROW], lambda row, n=iter((refuse, answer({"claims": [{}], "verdict": "supported"}))): next(n)(row))
    assert none.failures == odd.failures == ["NO_ANSWER"] and verification.verify(spark, [], refuse) == []


def test_form_of_answers():
    for bad in ({}, {"claims": [FIRST] * 16, "verdict": "supported"}, {"claims": [], "verdict": "maybe"}, {"claims": [{"id": 1}], "verdict": "supported"}):
        with pytest.raises(verification.Malformed):
            verification.checked(bad)
    assert verification.too_short({"finding": "x" * 30, "example": " y "}, {"finding": 20, "example": 20, "caution": 1}) == ["example: fewer than 20 characters", "caution: fewer than 1 characters"]


def test_prompts():
    pack = prompts.pack("en", system="other")
    assert pack.system == "other" and "Title: T\nVenue: \n" in prompts.source_text(pack, {"title": "T"})
    told = prompts.correction_text(pack, [{"block": "finding", "rule": "R1", "matched": "x", "severity": "hard"}, {"block": "finding", "rule": "R2", "matched": "y", "severity": "warn"}], ["a passage"])
    assert "- finding: R1 (x)" in told and "R2" not in told and told.endswith("- a passage") and prompts.correction_text(pack) == ""
    assert "Example: e" in prompts.verify_text(pack, "e", {"abstract": "A {x}"}) and prompts.filled("{a} {b}", {"a": 1}) == "1 {b}"
    with pytest.raises(ValueError):
        prompts.pack("xx")
