"""Verdicts of links parse and compare every page once, however many verdicts are made of it."""

import pytest

from snarewatch.operators import pages as P
from snarewatch.operators import spine as E
from snarewatch.operators import vectors as V
from snarewatch.plans import registry
from snarewatch.sources.fixtures import Tables

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, texts", [("link_verdict", 2), ("link_verdict_full", 2), ("link_verdict_degraded", 2), ("link_verdict_seen", 3)])
def test_pages_are_parsed_once(spark, monkeypatch, name, texts):
    # the whole text and that of a page's first characters, and for the memory the text it keeps
    calls, signed, plain, sign = [], [], P.page_text, V.minhash
    monkeypatch.setattr(P, "page_text", lambda html: calls.append(1) or plain(html))
    monkeypatch.setattr(V, "minhash", lambda *a: signed.append(1) or sign(*a))
    registry.queries()[name](spark, SMALL)
    assert len(calls) <= texts and len(signed) == 1


def test_texts_of_pages_are_judged_before_they_are_signed(spark, monkeypatch):
    carried, sign = [], V.minhash
    monkeypatch.setattr(V, "minhash", lambda rows, key, text, *more: carried.append(more) or sign(rows, key, text, *more))
    facts = E.page_facts(Tables(spark, SMALL)["page_obs"])
    assert {"posed", "posed_alike", "enough"} <= set(carried[0]) and not {"text", "shown"} & set(carried[0])
    assert facts.where("posed is not null and posed_alike is null").count() == 0 and facts.where("posed is not null").count() > 0
