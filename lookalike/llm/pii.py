"""Operator 10: personal data by offset-preserving deobfuscation.

Base spans are found in the text as it stands.  Then a chain of transducers rewrites the text:
look-alike characters become ASCII, spelled digits become digits, digit look-alikes inside numbers
become digits, and at/dot disguises become @ and '.'.  Every transducer returns its output
together with a map of offsets, the maps compose, and spans that the same detectors find in the
normalised text are carried back to offsets of the source text.  A span found that way is added
when a rewrite took part in it and it overlaps no base span of its kind, or holds more than
those it overlaps (a base span stays in any case).

Offsets are code points, end exclusive.  Edge cases: NULL text counts as empty and has no spans;
whole texts are scanned in linear time whatever their length; equal rows give equal spans; extra
columns pass through, and ``spans`` replaces an input column of that name; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookalike.llm.common import prepare, text_slices

KINDS = ("email", "ip", "card", "phone")

# ---------------------------------------------------------------- detectors

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_GROUPS = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3,}+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses.  Scans from each @ to the left, so that long runs of
    letters without @ cost one step per character."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digit groups joined by dots, taken four groups at a time; parts above 255 drop the match."""
    for run in _GROUPS.finditer(text):
        groups = list(re.finditer(r"[0-9]+", run.group()))
        for i in range(0, len(groups) - 3, 4):
            four = groups[i:i + 4]
            if all(len(p := g.group().lstrip("0")) <= 3 and int(p or "0") <= 255 for g in four):
                yield run.start() + four[0].start(), run.start() + four[3].end()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield m.span()


DETECTORS = dict(zip(KINDS, (emails, addresses, cards, phones)))

# ---------------------------------------------------------------- transducers

# Cyrillic and Greek letters that look like ASCII letters.
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХавеѕіјкмнорсухԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορυν",
    "ABESIJKMHOPCTYXabesijkmhopcyxdqwhABEZHIKMNOPTYXaopuv", strict=True))
# Dashes, spaces, dots and at signs; invisible characters vanish.
LOOKALIKES |= dict.fromkeys("‐‑‒–—−﹣－", "-") | dict.fromkeys("           　", " ")
LOOKALIKES |= dict.fromkeys("․。｡．", ".") | dict.fromkeys("＠﹫", "@") | dict.fromkeys("＋﹢", "+")
LOOKALIKES |= dict.fromkeys("​‌‍⁠﻿­", "")


def _ascii_of(c: str) -> str | None:
    """ASCII reading of a look-alike character, None when it is not one: the table above, decimal
    digits of any script, and compatibility forms (full width, mathematical, circled) of one
    ASCII letter, digit or sign."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    if unicodedata.decomposition(c).startswith("<"):
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain.isascii() and plain.isprintable():
            return plain
    return None


class _Lookalikes(dict):
    def __missing__(self, c: str):
        self[c] = got = None if c.isascii() else _ascii_of(c)
        return got


_ASCII_OF = _Lookalikes()
#: Characters that may be look-alikes: not ASCII and no accented Latin letter.
_FOREIGN = re.compile("[\xa0\xad\xb2\xb3\xb9\u0250-\U0010ffff]")

# Digit words (English, German, French, Spanish).
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8",
    "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SEP = r"[ ,.\-]{1,3}"
#: Three or more digit words (or digits) in a row, at least one of them a word; a leading "plus" may stand before.
_SPELLED = re.compile(rf"(?:\bplus {{1,3}})?(?<!\w)(?:(?:{_WORD})(?!\w)|[0-9]{{1,4}}(?= ))(?:(?:{_SEP}|[ ]?[()][ ]?)(?:(?:{_WORD})(?!\w)|[0-9]{{1,4}}(?!\w))){{2,}}", re.I)
_SPELLED_PART = re.compile(rf"\bplus {{1,3}}|(?<!\w)(?:{_WORD})(?!\w)", re.I)
_SPELLED_WORD = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)", re.I)
_NUMBER = re.compile(r"[0-9]+")
# Letters written for digits inside numbers.
DIGIT_LETTERS = {"O": "0", "o": "0", "Q": "0", "I": "1", "l": "1", "|": "1", "Z": "2", "S": "5", "B": "8"}
_MIXED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OoQIl|ZSB](?:[ ().-]{0,2}[0-9OoQIl|ZSB]){8,}(?![A-Za-z0-9])")
#: A bar with a blank or sign beside it parts two numbers.
_BORDER = re.compile(r"(?:(?<![0-9OoQIlZSB])|(?=\|[^0-9OoQIlZSB])|(?=\|\Z))\|")
_LOOSE_END = re.compile(r"(?:[ ().-]+[OoQIlZSB]+)+\Z")
_LOOSE_START = re.compile(r"\A(?:[OoQIlZSB]+[ ().-]+)+")
# Words for the at sign and the dot (English, German, French, Spanish).
_AT = r"at|ät|klammeraffe|arobase|arroba"
DOT_WORDS = ("dot", "punkt", "point", "punto", "period")
_DOT = "|".join(DOT_WORDS)
_BRACKET_AT = re.compile(rf"[ ]{{0,3}}[\[({{<][ ]{{0,2}}(?:{_AT}|@)[ ]{{0,2}}[\])}}>][ ]{{0,3}}", re.I)
_BRACKET_DOT = re.compile(rf"[ ]{{0,3}}[\[({{<][ ]{{0,2}}(?:{_DOT}|\.)[ ]{{0,2}}[\])}}>][ ]{{0,3}}", re.I)
#: name AT word DOT word ...: the bare words count only together, or beside a real sign; a dot between
#: blanks only before a small letter or a digit, as a sentence starts with neither.
_BARE_DOT = re.compile(rf"[ _]{{1,3}}(?:{_DOT})[ _]{{1,3}}|[ _]{{1,3}}\.[ _]{{1,3}}(?-i:(?=[a-z0-9]))|{_BRACKET_DOT.pattern}", re.I)
_BARE = re.compile(rf"(?<=[A-Za-z0-9])(?:[ _]{{1,3}}(?:{_AT}|@)[ _]{{1,3}}|@)(?=[A-Za-z0-9-])(?P<d>[A-Za-z0-9-]+(?:(?:{_BARE_DOT.pattern}|\.)[A-Za-z0-9-]+)+)", re.I)
_NAME_DOT = re.compile(rf"(?<=[A-Za-z0-9])[ _]{{1,3}}(?:{_DOT})[ _]{{1,3}}(?=[A-Za-z0-9._%+-]+@)", re.I)
_NUMBER_DOT = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:[ _]{{1,3}}(?:{_DOT})[ _]{{1,3}}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_BRACKET = re.compile(r"[\[({<]")
#: A digit beside a letter that may stand for one, with what may stand between them in _MIXED.
_BESIDE = re.compile(r"[0-9](?:(?=[ ().-]{0,2}[OoQIl|ZSB])|(?<=[OoQIl|ZSB][0-9])|(?<=[OoQIl|ZSB][ ().-][0-9])|(?<=[OoQIl|ZSB][ ().-]{2}[0-9]))")
_BREAKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_WORDS = re.compile(r"[^\W_]+")


@lru_cache(maxsize=2)
def _words(text: str) -> frozenset[bytes]:
    """Distinct lower-case words between any other signs; tells cheaply which transducers can find anything."""
    if text.isascii():
        return frozenset(text.encode().lower().translate(_BREAKS).split())
    return frozenset(w.encode("utf-8", "surrogatepass") for w in set(_WORDS.findall(text.lower())))


def _encoded(words) -> frozenset[bytes]:
    """UTF-8 forms of the words as ``_words`` gives them."""
    return frozenset(w.encode() for w in words)


_DIGIT_KEYS, _DOT_KEYS = _encoded(DIGIT_WORDS), _encoded(DOT_WORDS)


def look_alikes(text: str) -> list[tuple[int, int, str]]:
    """Edits (start, end, replacement) for characters that look like ASCII."""
    if text.isascii():
        return []
    return [(m.start(), m.end(), plain) for m in _FOREIGN.finditer(text) if (plain := _ASCII_OF[m.group()]) is not None]


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Runs of digit words become digits without separators between two words.  A run has three digit
    words, or two and no more numbers, or starts with one after a plus: an article beside a number
    is no digit."""
    edits = []
    if _words(text).isdisjoint(_DIGIT_KEYS):
        return edits
    for run in _SPELLED.finditer(text):
        said = len(_SPELLED_WORD.findall(run.group()))
        dialled = text[run.start() - 1:run.start()] == "+" and _SPELLED_WORD.match(text, run.start())
        if said < 3 and not dialled and (said < 2 or said < len(_NUMBER.findall(run.group()))):
            continue
        last = None
        for m in _SPELLED_PART.finditer(text, *run.span()):
            word = m.group().lower()
            if word.startswith("plus"):
                edits.append((m.start(), m.end(), "+"))
                last = m.end()
                continue
            start = m.start() if last is None or text[last:m.start()].strip(" ,.-") or last == m.start() else last
            edits.append((start, m.end(), DIGIT_WORDS[word]))
            last = m.end()
    return edits


def digit_letters(text: str) -> list[tuple[int, int, str]]:
    """Letters inside long numbers that stand for digits (at least six in ten characters are digits).
    A letter at an end of the number touches it, and a bar touches digits on both sides: what
    follows a blank is a word or a table's border."""
    edits = []
    if not _BESIDE.search(text):
        return edits
    for m in _MIXED.finditer(text):
        for run in _BORDER.split(m.group()):
            at = m.start() + m.group().index(run)
            run_end = _LOOSE_END.sub("", run)
            kept = _LOOSE_START.sub("", run_end)
            at += len(run_end) - len(kept)
            signs = [c for c in kept if c.isalnum() or c == "|"]
            if len(signs) >= 9 and sum(c.isdigit() for c in signs) * 10 >= 6 * len(signs):
                edits += [(at + i, at + i + 1, DIGIT_LETTERS[c]) for i, c in enumerate(kept) if c in DIGIT_LETTERS]
    return edits


def bracketed_signs(text: str) -> list[tuple[int, int, str]]:
    """"[at]", "(dot)" and the like, with the blanks around them."""
    if not _BRACKET.search(text):
        return []
    edits = [(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(text)]
    address = bool(edits) or "@" in text
    return sorted(edits + [(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(text)
                           if address or text[m.start() - 1:m.start()].isdigit() and text[m.end():m.end() + 1].isdigit()])


def bare_signs(text: str) -> list[tuple[int, int, str]]:
    """"name at word dot word": bare words, only where they form a whole address with a spelled,
    spaced or bracketed dot (a plain "at example.com" is left alone)."""
    edits = []
    if "@" not in text and not _BARE_DOT.search(text):
        return edits
    for m in _BARE.finditer(text):
        sign = m.group()[:m.start("d") - m.start()]
        dots = [(m.start("d") + d.start(), m.start("d") + d.end(), ".") for d in _BARE_DOT.finditer(m.group("d"))]
        if "@" in sign or dots:
            if sign != "@":
                edits.append((m.start(), m.start("d"), "@"))
            edits += dots
    return edits


def name_dots(text: str) -> list[tuple[int, int, str]]:
    """"first dot last@...": spelled dots before the at sign."""
    return [(m.start(), m.end(), ".") for m in _NAME_DOT.finditer(text)] if "@" in text else []


def number_dots(text: str) -> list[tuple[int, int, str]]:
    """"10 dot 0 dot 0 dot 1": spelled dots between four numbers."""
    if _words(text).isdisjoint(_DOT_KEYS):
        return []
    return [(m.start() + d.start(), m.start() + d.end(), ".")
            for m in _NUMBER_DOT.finditer(text) for d in _BARE_DOT.finditer(m.group())]


TRANSDUCERS = (look_alikes, spelled_digits, digit_letters, bracketed_signs, bare_signs, name_dots, number_dots)


class Rewritten:
    """A text after edits, with the map of its offsets to the offsets before."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        out, at, new = [], 0, 0
        self.new, self.old, self.edited = [0], [0], [False]
        for start, end, put in edits:
            if start < at:
                continue
            out += (text[at:start], put)
            new += start - at
            self._mark(new, start, True)
            new += len(put)
            self._mark(new, end, False)
            at = end
        out.append(text[at:])
        self.text = "".join(out)
        self.length = len(text)

    def _mark(self, new: int, old: int, edited: bool) -> None:
        self.new.append(new)
        self.old.append(old)
        self.edited.append(edited)

    def before(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of [start, end), and whether an edit lies in it."""
        i = bisect_right(self.new, start) - 1
        old_start = self.old[i] + (0 if self.edited[i] else start - self.new[i])
        j = bisect_right(self.new, end - 1) - 1
        old_end = self.old[j + 1] if self.edited[j] else self.old[j] + end - self.new[j]
        # an edit that replaced nothing visible (a vanished character) also counts
        return old_start, old_end, any(self.edited[i:j + 1]) or old_end - old_start != end - start


def find_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, base) of a text by start, then kind."""
    base = {kind: list(find(text)) for kind, find in DETECTORS.items()}
    spans = [(kind, s, e, True) for kind in KINDS for s, e in base[kind]]
    chain, now = [], text
    for transducer in TRANSDUCERS:
        if edits := transducer(now):
            chain.append(Rewritten(now, edits))
            now = chain[-1].text
    if chain:
        for kind, find in DETECTORS.items():
            ends = [e for _, e in base[kind]]
            for start, end in find(now):
                touched = False
                for step in reversed(chain):
                    start, end, edited = step.before(start, end)
                    touched |= edited
                if touched:
                    i = bisect_right(ends, start)
                    within = base[kind][i:bisect_right(ends, end)]
                    beyond = base[kind][i + len(within)][0] < end if i + len(within) < len(ends) else False
                    if not beyond and all(start <= s and (s, e) != (start, end) for s, e in within):
                        spans.append((kind, start, end, False))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


# ---------------------------------------------------------------- Spark

SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()),
    T.StructField("text", T.StringType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("base", pa.bool_()), ("text", pa.string())]))


def detect(df: DataFrame, column: str = "text", out: str = "spans", keep_text: bool = True) -> DataFrame:
    """Add ``out``: array of (kind, start, end, base, source text) of every whole text."""
    prepare(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name != out and (keep_text or f.name != column)]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(SPAN))])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column):
            found = []
            for value in batch.column(column):
                text = value.as_py() or ""
                found.append([{"kind": k, "start": s, "end": e, "base": b, "text": text[s:e]}
                              for k, s, e, b in find_spans(text)])
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {out: pa.array(found, _ARROW_SPANS)})
    return df.mapInArrow(run, schema)


def redact(df: DataFrame, column: str = "text", spans: str = "spans") -> DataFrame:
    """Replace every span of ``column`` by [KIND] (overlapping spans by the first one's kind)."""
    step = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], F.substring(F.col(column), acc["at"] + 1, s["start"] - acc["at"]),
                     F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("at"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col(column), acc["at"] + 1, F.length(column))))
    return df.withColumn(column, F.when(F.size(spans) > 0, step).otherwise(F.col(column)))


def joined(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(df: DataFrame) -> DataFrame:
    """Query form: base counts per kind, the digest of the base spans, and all spans."""
    found = detect(df.select("doc_id", "text"), keep_text=False)
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("bigint").alias("n_added"))
