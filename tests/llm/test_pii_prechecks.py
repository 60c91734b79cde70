"""Disguises that the cheap looks before the patterns must not lose."""

import pytest

from lookalike.llm import pii


@pytest.mark.parametrize("text,kind", [
    ("john at example . com", "email"), ("john at example [dot] com", "email"), ("john at example (dot) com", "email"),
    ("+4 9 O 1 7 2 3 4 5 6 7", "phone"), ("+49 17 2.O.4-5 6 7 8 9", "phone"), ("+one 555 123 4567", "phone"),
])
def test_disguises_alone_in_their_text_are_found(text, kind):
    assert pii.find_spans(text) == [(kind, 0, len(text), False)]


@pytest.mark.parametrize("text", ["we met at noon. Then we left", "in 2019. In 5 Options", "look at it [now] all"])
def test_plain_texts_have_no_spans(text):
    assert pii.find_spans(text) == []
