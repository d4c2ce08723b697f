from __future__ import annotations

import random

import pytest

from lintel.llm import pii, queries
from lintel.llm.edit_counts import TokenTree


def edited(text):
    tree = TokenTree(text, len)
    tree.apply(queries._masks(text))
    return tree.text


@pytest.mark.parametrize(
    "text,after,n",
    [
        ("a@b.de writes\nmore\na@b.de writes\nend", "[EMAIL] writes\nmore\nend", 2),
        ("1.2.3.4 up\n1.2.3.4 up\n", "[IP] up\n", 2),
        ("to 1.2.3.4@x.com now", "to [EMAIL] now", 1),
        ("x y\nx y", "x y\n", 1),
    ],
)
def test_cut_lines_and_joined_spans(text, after, n):
    assert edited(text) == after and len(queries._masks(text)) == n


def test_masks_are_the_masked_text_without_repeated_lines():
    r = random.Random(2)
    lines = ["a@b.de x", "1.2.3.4@x.com", "+1 743 555 3824 1.2.3.4", "plain", "", "bob (at) x [dot] org", "4111 1111 1111 1111@a.de", " ", "1.2.3.4"]
    for _ in range(500):
        text, seen, kept = "\n".join([*(r.choice(lines) for _ in range(r.randint(0, 12))), "end"]), set(), []
        for line in text.split("\n"):
            if not line.strip() or line not in seen:
                kept.append(pii.masked(line, [s for part in pii.find(line) for s in part]))
            seen.add(line)
        edits = queries._masks(text)
        assert all(a.end <= b.start for a, b in zip(edits, edits[1:], strict=False))
        assert edited(text) == "\n".join(kept)
