"""Personal data in texts, disguised or not, with the places in the source.

Plain identifiers (e-mail addresses, IP addresses, card and phone numbers) are
found in the text as it stands. A text with signs of disguise also passes through
a chain of transducers. Each rewrites the text and hands on, for every character
it writes, the stretch of source characters that it stands for:

* ``fold``: compatibility forms (full-width, mathematical), look-alike letters of
  Cyrillic and Greek, digits of other scripts; invisible characters vanish;
* ``at_dot``: "name [at] host (dot) org", "name at host dot org", "name_at_host_dot_org"
  become an address;
* ``dotted``: four numbers between dots of which some are disguised, "10[.]0[.]0[.]1" or
  "one nine two dot one six eight dot one dot one", become an address;
* ``spoken``: three or more spelled digits in a row become digits ("plus" before
  them a plus sign, "double" and "triple" repeat the next).

Words are English, German, French and Spanish ones.

What is found in the rewritten text, and wasn't plain, is mapped back to the
stretch of source characters. It is added unless a span of its kind holds all of it;
so a partly disguised identifier is added beside the plain span of its undisguised part.

A null text is empty and has no spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io

KINDS = ("email", "ip", "card", "phone")
#: An address from its sign on; its name is looked for backwards, as a forward search over a long word takes quadratic time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_NAME = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Letters that look like ASCII ones, by the ASCII letter.
_ALIKE = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "ј", "k": "κ", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ", "z": "ʐ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ",
    "@": "＠﹫", ".": "．。｡․", "+": "＋﹢", "-": "‐‑‒–—−﹣－", " ": "    　",
}
FOLD = {ord(x): to for to, many in _ALIKE.items() for x in many}
INVISIBLE = frozenset([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF])
#: Spelled digits in English, German, French and Spanish.
_SPELLED = {
    "0": "zero oh null zéro cero", "1": "one eins un une uno una", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
DIGIT_WORDS = {w: d for d, words in _SPELLED.items() for w in words.split()}
REPEATS = {"double": 2, "triple": 3}

_LETTER = r"[^\W\d_]"
_word = "|".join(sorted([*DIGIT_WORDS, *REPEATS], key=len, reverse=True))
_SPOKEN = re.compile(rf"(?i)(?<!\w)(?:plus[\s,.-]+)?(?:{_word}|[0-9])(?:[\s,.-]+(?:{_word}|[0-9])){{2,}}(?!{_LETTER})")
_SPOKEN_WORD = re.compile(rf"(?i)(plus)|({_word})|([0-9])")
_ats, _dots = "at|arroba|arobase|ät", "dot|punto|punkt|point"
_AT = rf"(?:\s*[\[({{<]\s*(?:{_ats}|@)\s*[\])}}>]\s*|\s+(?:{_ats})\s+|\s*@\s*)"
_DOT = rf"(?:\s*[\[({{<]\s*(?:{_dots}|\.)\s*[\])}}>]\s*|\s+(?:{_dots})\s+|\.)"
#: An at sign, disguised or not, and what follows it; the name before it is read backwards, as a forward search would start anew at each of its parts.
_AT_HOST = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+.-])({_AT})([A-Za-z0-9-]+)((?:{_DOT}[A-Za-z0-9-]+)+)")
_stod = _dots[::-1]
_TOD = rf"(?:\s*[\])}}>]\s*(?:{_stod}|\.)\s*[\[({{<]\s*|\s+(?:{_stod})\s+|\.)"
_EMAN = re.compile(rf"(?i)[A-Za-z0-9_%+-]+(?:{_TOD}[A-Za-z0-9_%+-]+)*")
_DOT_PART = re.compile(rf"(?i){_DOT}")
#: A whole address in one word: name_at_host_dot_org.
_ONE_WORD = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+?)([_-](?:{_ats})[_-])([A-Za-z0-9]+)((?:[_-](?:{_dots})[_-][A-Za-z0-9]+)+)(?![A-Za-z0-9])")
_ONE_WORD_DOT = re.compile(rf"(?i)[_-](?:{_dots})[_-]")
#: Four numbers, in digits or spelled, between dots of which one at least is disguised.
_OCTET = rf"(?:(?:{_word})(?:[\s-]+(?:{_word})){{0,2}}|[0-9]{{1,3}})"
_IP_DOT = rf"(?:\s*[\[({{<]\s*(?:{_dots}|\.)\s*[\])}}>]\s*|\s+(?:{_dots})\s+|\.)"
_DOTTED = re.compile(rf"(?i)(?<![\w.]){_OCTET}(?:{_IP_DOT}{_OCTET}){{3}}(?!\w)")
_IP_DOT_PART = re.compile(rf"(?i)({_IP_DOT})")
#: What must be in a text for it to be worth rewriting, besides characters that ``fold`` changes.
_CUE_AT = re.compile(rf"[\[({{<]\s*(?:{_ats}|@|{_dots}|\.)\s*[\])}}>]")
_CUE_DOT = re.compile(rf"[\s_-](?:{_dots})[\s_-]|\s(?:arroba|arobase|ät)\s")
_CUE_SPOKEN = re.compile(rf"\b(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))})[\s,.-]+(?:{_word}|[0-9])(?!{_LETTER})")
_CUE_FOLD = re.compile("[" + "".join(map(re.escape, map(chr, sorted(set(FOLD) | INVISIBLE)))) + "０-９Ａ-Ｚａ-ｚ٠-٩۰-۹०-९\U0001d400-\U0001d7ff]")

#: UTF-8 bytes with ASCII characters that aren't letters as spaces.
_SPACED = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))
_DIGIT_BYTES = frozenset(w.encode() for w in DIGIT_WORDS)
_CUE_WORDS = ("dot", "punto", "punkt", "point", "arroba", "arobase", "ät")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """The check of card numbers: every second digit from the right doubled, digit sums, a multiple of ten."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost first, without overlap."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done:
            low = max(done, start - 64)
            stops = [x.end() for x in _NOT_NAME.finditer(text, low, start)]
            start = stops[-1] if stops else low
            if stops:
                break
        if start < m.start():
            done = m.end()
            yield start, done


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") <= 255


def plain(text: str) -> list[Span]:
    """Identifiers as they stand, leftmost first within each kind; a match that fails its check is dropped."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", *span) for span in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))] if "." in text else []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


class Tape:
    """A text under rewriting: each character with the stretch of source characters it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def splice(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches, given in order; every new character stands for the whole stretch's source."""
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = start + self.start[at:], end + self.end[at:]


def fold(tape: Tape) -> None:
    edits = []
    for m in _CUE_FOLD.finditer(tape.text):
        c = m[0]
        if ord(c) in INVISIBLE:
            new = ""
        elif ord(c) in FOLD:
            new = FOLD[ord(c)]
        else:
            new = str(unicodedata.decimal(c)) if unicodedata.decimal(c, None) is not None else unicodedata.normalize("NFKC", c)
        edits.append((*m.span(), new))
    tape.splice(edits)


def at_dot(tape: Tape) -> None:
    edits, back, done = [], "", 0
    for m in _AT_HOST.finditer(tape.text):
        if re.fullmatch(r"(?i)\s+at\s+", m[1]) and not re.search(rf"(?i){_dots}|[\[({{<]", m[3]):
            continue  # an ordinary "at" before an ordinary abbreviation or the end of a sentence
        back = back or tape.text[::-1]
        n = len(back)
        name = _EMAN.match(back, n - m.start(), n - done)
        if name is None:
            continue
        edits += [(n - name.end() + d.start(), n - name.end() + d.end(), ".") for d in _DOT_PART.finditer(name[0][::-1])]
        edits.append((*m.span(1), "@"))
        edits += [(m.start(3) + d.start(), m.start(3) + d.end(), ".") for d in _DOT_PART.finditer(m[3])]
        done = m.end()
    tape.splice(edits)
    edits = []
    for m in _ONE_WORD.finditer(tape.text):
        edits.append((*m.span(2), "@"))
        edits += [(m.start(4) + d.start(), m.start(4) + d.end(), ".") for d in _ONE_WORD_DOT.finditer(m[4])]
    tape.splice(edits)


def _digits(said: str) -> str:
    out, times = "", 1
    for plus, word, digit in _SPOKEN_WORD.findall(said):
        if plus:
            out += "+"
        elif word.lower() in REPEATS:
            times = REPEATS[word.lower()]
        else:
            out += (digit or DIGIT_WORDS[word.lower()]) * times
            times = 1
    return out


def dotted(tape: Tape) -> None:
    edits = []
    for m in _DOTTED.finditer(tape.text):
        parts = _IP_DOT_PART.split(m[0])
        if all(x == "." for x in parts[1::2]):
            continue
        at = m.start()
        for i, part in enumerate(parts):
            if i % 2 or part[0].isalpha():
                edits.append((at, at + len(part), "." if i % 2 else _digits(part)))
            at += len(part)
    tape.splice(edits)


def spoken(tape: Tape) -> None:
    edits = []
    for m in _SPOKEN.finditer(tape.text):
        digits = _digits(m[0])
        if re.search(_LETTER, m[0]) and len(digits) >= 3:
            edits.append((*m.span(), digits))
    tape.splice(edits)


def disguised(text: str) -> list[Span]:
    """What the transducers bring to light, in source offsets."""
    folds, low = not text.isascii() and _CUE_FOLD.search(text), text.lower()
    if not folds and not (any(w in low for w in _CUE_WORDS) and _CUE_DOT.search(low)) and not (any(c in low for c in "[({<") and _CUE_AT.search(low)) and (_DIGIT_BYTES.isdisjoint(low.encode("utf-8", "surrogatepass").translate(_SPACED).split()) or not _CUE_SPOKEN.search(low)):
        return []
    tape = Tape(text)
    if folds:
        fold(tape)
    at_dot(tape)
    dotted(tape)
    spoken(tape)
    out = []
    for kind, a, b in plain(tape.text):
        start, end = tape.start[a], tape.end[b - 1]
        if text[start:end] != tape.text[a:b]:
            out.append((kind, start, end))
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans), each by kind as in ``KINDS``, then by start."""
    text = text or ""
    base = plain(text)
    order = lambda x: (KINDS.index(x[0]), *x[1:])
    added, last, reach = [], "", 0
    for kind, start, minus, late in sorted({(k, s, -e, False) for k, s, e in base} | {(k, s, -e, True) for k, s, e in disguised(text)}):
        if kind != last:
            last, reach = kind, 0
        if late and -minus > reach:  # none that began before it, or with it, holds all of it
            added.append((kind, start, -minus))
        reach = max(reach, -minus)
    return sorted(base, key=order), sorted([*base, *added], key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): counts of plain spans, their digest, all spans, and how many the transducers added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in _SCHEMA if f.name != "doc_id"}
            for text in batch.column(1):
                base, spans = find(text.as_py())
                for k in KINDS:
                    rows[f"n_{k}"].append(sum(x[0] == k for x in base))
                rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows["spans"].append(joined(spans))
                rows["n_added"].append(len(spans) - len(base))
            yield _io.to_batch(_SCHEMA, rows | {"doc_id": batch.column(0)})

    return _io.pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, _SCHEMA)


def hide(text: str) -> str:
    """The text with each span, plain or disguised, replaced by its kind in brackets; of spans that overlap, their union."""
    spans = sorted((s, e, k) for k, s, e in find(text)[1])
    out, at = [], 0
    while spans:
        start, end, kind = spans.pop(0)
        while spans and spans[0][0] < end:
            end = max(end, spans.pop(0)[1])
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``column``; a null text stays null. Other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(column)
            texts = [None if x.as_py() is None else hide(x.as_py()) for x in batch.column(i)]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
