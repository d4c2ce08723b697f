from __future__ import annotations

import random
import re
from re import _parser

import pytest

from lintel.llm import licenses
from lintel.llm.license_rules import signatures

from .test_licenses import scanned

WRAPPED = ["All\nRights Reserved", "ALL  RIGHTS\tRESERVED", "put into the public\ndomain", "into the Public-Domain", "open data\ncommons public domain dedication", "MIT (no\nattribution)", "Unicode terms\nof use", "see mozilla/org/MPL", "wtfpl-net"]


def sample(r, parsed):
    """Some text that a parsed pattern matches."""
    out = []
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(value))
        elif name == "IN":
            kind, first = value[0]
            out.append(chr(first[0] if str(kind) == "RANGE" else first))
        elif name == "BRANCH":
            out.append(sample(r, r.choice(value[1])))
        elif name == "SUBPATTERN":
            out.append(sample(r, value[3]))
        else:
            assert name == "MAX_REPEAT", name
            out += [sample(r, value[2]) for _ in range(r.randint(value[0], min(value[1], value[0] + 1)))]
    return "".join(out)


def parted(r, text):
    return "".join(r.choice(["\n", " \t", "-", "/", ", "]) if c == " " else r.choice([c, c.upper()]) for c in text)


@pytest.mark.parametrize("text", WRAPPED)
def test_wrapped_terms_pass_the_gate(spark, text):
    row = scanned(spark, [text])[0]
    assert row["labels"] and row["score"] > 0


def test_gate_changes_nothing(spark, monkeypatch):
    r = random.Random(5)
    texts = [parted(r, t) for s in signatures() for t in [sample(r, _parser.parse(s.pattern)) for _ in range(2)] if re.fullmatch(s.pattern, t)] + ["no rights", "plain prose", ""]
    assert len(texts) > 2 * 390
    gated = scanned(spark, texts)
    monkeypatch.setattr(licenses, "GATE", ("",))
    free = scanned(spark, texts)
    assert [t for i, t in enumerate(texts) if gated[i] != free[i]] == []
