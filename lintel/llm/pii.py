"""Personal data with offset-preserving deobfuscation.

Identifiers are found in the source text first. Transducers then rewrite disguises (look-alike characters, spelled
digits, written-out at and dot) into plain characters, each of which keeps the source span that it came from; what is
found in the rewritten text is mapped back, and added where no plain finding lies. Secrets, which have no base pattern,
are added as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import map_batches
from .shared import beside

#: Kinds with a base pattern, and all in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
Span = tuple[str, int, int]
Edit = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its first digit fails from the others, and matches end where runs end
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_DOTTED = re.compile(r"[0-9]\.[0-9]+\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TWELVE = re.compile(r"[0-9](?:[ -]?[0-9]){11}")
_NO_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> list[Span]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ from each @ outwards, so long runs without one cost nothing."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        last = match.end() if match else at + 1
        if match:
            found.append(("email", start, last))
        at = text.find("@", last)
    return found


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def plain(text: str) -> list[Span]:
    """The identifiers of a text as (kind, start, end) in code points, by start and kind."""
    found = _emails(text)
    if _DOTTED.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    if _TWELVE.search(text):
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: Characters that look like an ASCII one.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
#: Characters without width, which vanish.
INVISIBLE = "​‌‍⁠﻿­"
#: Digit words, in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

#: Names that a secret is assigned to, and forms that tell a secret by themselves.
SECRET_NAMES = ("token", "secret", "passwd", "password", "passphrase", "api key", "apikey", "access key", "private key", "auth key", "authorization", "bearer", "credential")
SECRET_FORMS = (r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36,}", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"sk-[A-Za-z0-9_-]{20,}", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
#: A value of 16 characters or more, of which one is a digit, behind a name and a sign or the word bearer.
_ASSIGNED = re.compile(rf"(?i)(?:{'|'.join(n.replace(' ', '[ _-]?') for n in SECRET_NAMES)})['\"]?(?:\s{{0,4}}[:=]{{1,2}}>?\s{{0,4}}(?:bearer\s)?|\s)['\"]?(?=[A-Za-z_+/=.~-]*[0-9])([A-Za-z0-9_+/=.~-]{{16,}})")
_SECRET_FORM = re.compile(rf"(?<![A-Za-z0-9_-])(?:{'|'.join(SECRET_FORMS)})(?![A-Za-z0-9_-])|-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----")
#: One of these is in the lower-cased text of any secret. A dotted or dotless i counts as i where case does not, so only akia, whose case counts, has that letter.
_SECRET_HINTS = ("token", "secret", "pass", "key", "auth", "bearer", "credent", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "eyj")


def secrets(text: str) -> list[Span]:
    """The secrets of a text: values assigned to a name that says so, and forms of well-known issuers."""
    lower = text.lower().replace("ſ", "s")
    if not any(hint in lower for hint in _SECRET_HINTS):
        return []
    found = sorted([(m.start(1), m.end(1)) for m in _ASSIGNED.finditer(text)] + [m.span() for m in _SECRET_FORM.finditer(text)])
    out: list[Span] = []
    for start, end in found:
        if not out or start >= out[-1][2]:
            out.append(("secret", start, end))
    return out


_DIGIT = f"(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))}|[0-9])"
#: Four digits in a row of which some are words: fewer are left alone as prose.
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:{_DIGIT}[ .,-]{{1,2}}){{3,}}{_DIGIT}(?!\w)")
_SPELLED_WORD = re.compile(r"(?i)[^\W\d_]+")
_PLUS = re.compile(rf"(?i)(?<!\w)plus (?={_DIGIT}[ .,-])")
_AT = re.compile(r"(?i) ?(?:[\[({<] ?(?:at|@|arroba|chez|ät) ?[\])}>]) ?")
_DOT = re.compile(r"(?i) ?(?:[\[({<] ?(?:dot|punkt|point|punto|\.) ?[\])}>]) ?")
_BARE = re.compile(r"(?i)(?<![\w.%+-])[a-z0-9._%+-]{1,64}( at )[a-z0-9-]{1,63}(?:(?: dot |\.)[a-z0-9-]{1,63}){0,8}( dot )(?:com|org|net|edu|gov|info|biz|io|co|uk|eu|us|de|fr|es|ch|at|ca|au)(?!\w)")
_BARE_DOT = re.compile(r"(?i) dot ")


@lru_cache(maxsize=1)
def _table() -> dict[str, str]:
    """Look-alikes, full-width forms and other scripts' decimal digits."""
    wide = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    digits = {chr(i): str(unicodedata.decimal(chr(i))) for i in range(0x80, 0x1_E000) if unicodedata.decimal(chr(i), None) is not None}
    return digits | wide | LOOK_ALIKES | dict.fromkeys(INVISIBLE, "")


@lru_cache(maxsize=1)
def _disguised() -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, _table())) + "]")


def _characters(text: str) -> list[Edit]:
    return [] if text.isascii() else [(m.start(), m.end(), _table()[m[0]]) for m in _disguised().finditer(text)]


def _spelled(text: str) -> list[Edit]:
    edits = [(m.start(), m.end(), "+") for m in _PLUS.finditer(text)]
    for m in _SPELLED.finditer(text):
        edits += [(w.start() + m.start(), w.end() + m.start(), DIGIT_WORDS[w[0].lower()]) for w in _SPELLED_WORD.finditer(m[0])]
        edits += [(i.start() + m.start(), i.end() + m.start(), " ") for i in re.finditer(r"[.,-] |  |,", m[0])]
    return sorted(edits)


def _written(text: str) -> list[Edit]:
    edits = [(m.start(), m.end(), "@") for m in _AT.finditer(text)] + [(m.start(), m.end(), ".") for m in _DOT.finditer(text)]
    for m in _BARE.finditer(text):
        edits.append((m.start(1), m.end(1), "@"))
        edits += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(text, m.end(1), m.end())]
    return sorted(edits)


#: A transducer lists the edits of a text; they are run one after the other.
TRANSDUCERS: tuple[Callable[[str], list[Edit]], ...] = (_characters, _spelled, _written)
_BRACKETED = re.compile(r"(?i)[\[({<] ?(?:at|@|arroba|chez|ät|dot|punkt|point|punto|\.) ?[\])}>]")
_DIGITS_APART = re.compile(r"[0-9][ .,-]{1,2}[0-9]")
_THREE_DIGITS = re.compile(rf"(?i){_DIGIT}[ .,-]{{1,2}}{_DIGIT}[ .,-]{{1,2}}{_DIGIT}(?!\w)")


def _may_hide(text: str) -> bool:
    """Whether some transducer may find something. Cheap tests come first; of four spelled digits in a row, the inner two stand apart as words or digits.

    A long s counts as the s of plus, and no other letter as p, l or u.
    """
    if not text.isascii():
        try:
            text.encode("latin-1")
            odd = "\xa0" in text or "\xad" in text
        except UnicodeEncodeError:
            odd = _disguised().search(text) is not None
        if odd:
            return True
    lower = text.lower()
    if " dot " in lower or _BRACKETED.search(text) or ("plu" in lower and _PLUS.search(text)):
        return True
    words = lower.replace("-", " ").replace(",", " ").replace(".", " ").split()
    return (not DIGIT_WORDS.keys().isdisjoint(words) or _DIGITS_APART.search(text) is not None) and _THREE_DIGITS.search(text) is not None


def rewritten(text: str) -> tuple[str, list[int], list[int], list[bool]]:
    """The text after all transducers, and of each of its characters the source span and whether it was rewritten."""
    starts, ends, changed = list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)
    for transducer in TRANSDUCERS:
        out, at, maps = [], 0, ([], [], [])
        for a, b, put in transducer(text):
            if a < at:
                continue
            for x, y in zip(maps, (starts, ends, changed), strict=True):
                x += y[at:a]
            out += [text[at:a], put]
            for x, y in zip(maps, (starts[a], ends[b - 1], True), strict=True):
                x += [y] * len(put)
            at = b
        if at:
            out.append(text[at:])
            for x, y in zip(maps, (starts, ends, changed), strict=True):
                x += y[at:]
            text, (starts, ends, changed) = "".join(out), maps
    return text, starts, ends, changed


def find(text: str) -> tuple[list[Span], list[Span]]:
    """The plain identifiers of a text, and the disguised ones and secrets, as source spans. A further one touches no plain one."""
    base = plain(text)
    more = [s for s in secrets(text) if not any(a < s[2] and s[1] < b for _, a, b in base)]
    if not _may_hide(text):
        return base, more
    clear, starts, ends, changed = rewritten(text)
    if not any(changed) and clear == text:
        return base, more
    for kind, a, b in plain(clear):
        start, end = starts[a], ends[b - 1]
        # a character that vanished leaves a gap between the spans of its neighbours
        touched = any(changed[a:b]) or end - start != b - a
        if touched and not any(s < end and start < e for _, s, e in [*base, *more]):
            more.append((kind, start, end))
    return base, sorted(more, key=lambda s: (s[1], s[2]))


def _record(span: Span, is_plain: bool) -> dict:
    return {"kind": span[0], "start": span[1], "end": span[2], "plain": is_plain}


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("plain", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))


def detect(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns of docs with `spans`: array of (kind, start, end, plain) by start and kind, in code points.

    Null and empty texts have an empty array. Whole texts are read; rows are looked at one by one, so repeated rows
    give repeated results. A carried column called spans, in any case, gets _in behind it. Beyond the base patterns, an
    address with a bare "at" needs a "dot" and a top-level domain of a short list behind it, and has at most 64
    characters before the "at", 63 in a label and 10 labels; spelled digits count from four in a row on.
    """
    inner = docs.select(*(docs[c] for c in carry), docs[text]).toDF(*beside([*carry], ("spans", "__text")), "__text")
    schema = T.StructType([*inner.schema.fields[:-1], T.StructField("spans", _SPAN)])

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for body in batch.column(batch.num_columns - 1).to_pylist():
                base, more = find(body or "")
                rows.append(sorted([*(_record(s, True) for s in base), *(_record(s, False) for s in more)], key=lambda r: (r["start"], ALL_KINDS.index(r["kind"]), r["end"])))
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, _ARROW)], [*batch.schema.names[:-1], "spans"])

        return each

    return map_batches(inner, schema, make)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, joined where they overlap, replaced by the kind of its first in capitals, as in [EMAIL]."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all findings masked in its text column; null stays null, other columns and repeated rows stay."""
    at = docs.columns.index(text)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = batch.columns
            columns[at] = pa.array([None if x is None else masked(x, [s for part in find(x) for s in part]) for x in columns[at].to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return each

    names = docs.columns
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return map_batches(numbered, numbered.schema, make).toDF(*names)
