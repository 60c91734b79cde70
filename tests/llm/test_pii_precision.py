"""What the transducers add: planted disguises are found, prose, tables and articles are left alone."""

import random

import pyarrow.parquet as pq
import pytest

from lookalike.llm import pii

WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
LETTERS = {"0": "O", "1": "l", "5": "S", "8": "B"}


@pytest.mark.parametrize("text,base", [
    ("| +1 (599) 555-3756 | 12 |", [("phone", 2, 19)]), ("+1 (848) 555-1373 Un homme", [("phone", 0, 17)]),
    ("tel +34 600 123 456 un dos", [("phone", 4, 19)]), ("We met at noon . Then left", []), ("| 4111 1111 1111 1111 | I |", [("card", 2, 21)]),
    ("rows 12 | 34 | 56 | 78 | 90 | 12 | 34", []), ("In 1999 I sold 100 200 300 Z 5", []), ("un 12 000 345 678 habitants", []),
])
def test_nothing_is_added_to_plain_texts(text, base):
    assert [x[:3] for x in pii.find_spans(text)] == base


def test_nothing_is_added_to_the_given_tables():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    assert not [x for t in texts for x in pii.find_spans(t or "") if not x[3]]


def disguise(rng):
    """(text of a disguised item, kind, where it starts, where it ends)."""
    kind = rng.choice(["at", "spelled", "letters", "homoglyph"])
    if kind == "at":
        name, host, end = rng.choice(["mara", "jo.lee", "x_1"]), rng.choice(["mail", "post-box"]), rng.choice(["org", "example"])
        return name + rng.choice([" at ", " [at] ", " (AT) ", " {arroba} "]) + host + rng.choice([" dot ", " [dot] ", " punto "]) + end, "email"
    digits = "".join(rng.choice("0123456789") for _ in range(rng.randrange(9, 13)))
    if kind == "spelled":
        return "plus " + rng.choice([" ", ", ", "-"]).join(WORDS[int(c)] for c in digits), "phone"
    if kind == "letters":
        at = rng.sample(range(2, len(digits) - 1), 3)
        return "+" + "".join(LETTERS.get(c, c) if i in at else c for i, c in enumerate("49" + digits[2:])), "phone"
    return "m\u0430ra@m\u0430il.\u043erg", "email"


def test_planted_disguises_are_found_where_they_stand():
    rng = random.Random(4)
    found = total = 0
    for _ in range(400):
        hidden, kind = disguise(rng)
        before, after = rng.choice(["Write to: ", "see (", "", "\n- "]), rng.choice(["", "; thanks", "\nnext line", ") end"])
        spans = [x for x in pii.find_spans(before + hidden + after) if x[0] == kind]
        total += 1
        found += any((s, e) == (len(before), len(before) + len(hidden)) for _, s, e, _ in spans)
    assert found >= 0.97 * total
