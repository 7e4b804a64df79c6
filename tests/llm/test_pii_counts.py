"""The counts beside the base digest are those of the base spans, whatever the tagger adds."""

from __future__ import annotations

import hashlib

from gneiss.llm import pii

TEXTS = [
    "Please write to john.smith [at] example [dot] com or a@b.co, from 1.2.3.4 only.",
    "My address is anna.berg＠firma．de and the other one is john＠example.com today.",
    "Contact me: maria (at) mail (dot) org, phone +1 (743) 555-3824, thanks.",
]


def test_counts_are_of_base_spans(spark):
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).orderBy("doc_id").collect()
    base = [pii.base_spans(t) for t in TEXTS]
    assert sum(len(r.spans.split(",")) for r in rows) > sum(map(len, base))  # the tagger added some
    for row, own in zip(rows, base):
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[1] == k for s in own) for k in range(4)]
        assert row.base_sha256 == hashlib.sha256(pii.shown(own).encode()).hexdigest()
