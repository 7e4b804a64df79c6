"""All of the clean-pair validator's codes come out of a registered query."""

from __future__ import annotations

from gneiss.plans import answers

SF = "/root/testdata/sf0.001"


def test_clean_pair_issues_of_texts(spark):
    found = {r.code: r.n for r in answers.clean_pair_all_issues(spark, SF).collect()}
    rest = {r.code: r.n for r in answers.clean_pair_issues(spark, SF).collect()}
    assert set(found) - set(rest) == {"EMPTY_CLEAN_TEXT", "LOW_TEXT_RETENTION", "UNEXPECTED_TEXT_EXPANSION"}
    assert all(found[c] == n for c, n in rest.items())
