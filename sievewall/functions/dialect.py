"""One pattern, three engines: ECMAScript patterns rendered for Spark (Java) and DuckDB (RE2).

Classes are spelled out, so that both engines agree with the source dialect: white
space is Unicode's and the byte order mark, a dot excludes four line ends, a word
boundary is ASCII, ``$`` is the very end. RE2 repeats a group without bound; Java's
matcher recurses on it and overflows its stack, so there the groups of ``FINAL`` are
possessive, which changes no match, and any other repeats at most ``MOST`` times.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants, _parser

from .errors import ConfigurationError

_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_JAVA_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_TOKEN = re.compile(r"\\u([0-9a-fA-F]{4})|\\(.)|(\[)|(\])|(\)[*+])|([.$])|(.)", re.S)
#: Repeated groups that no match needs to give back: their words end in white space and can't begin what follows them in any rule.
FINAL = frozenset([r"(?:(?:all|the|user)\s+)*", r"(?:(?:trusted|verified|authenticated|authorized)\s+)+", r"(?:(?:academic|educational|scholarly|research)(?:\s+and\s+|\s+))+"])
#: How often any other group without bound (of a rule of one's own) may repeat in Spark.
MOST = 1000
#: White space as a character class of both engines: what a blank text consists of.
BLANK = rf"^[{_SPACE}]*\z"


@lru_cache(None)
def render(pattern: str, engine: str, flags: str = "i") -> str:
    """``pattern`` for ``engine`` ("spark" or "duckdb"), flags included."""
    out, inside = [], False
    for m in _TOKEN.finditer(pattern):
        code, escape, opens, closes, group, special, _ = m.groups()
        if code:
            out.append(rf"\x{{{code.upper()}}}")
        elif escape == "s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
        elif escape == "S":
            out.append(f"[^{_SPACE}]")
        elif escape == "b":
            out.append(_JAVA_EDGE if engine == "spark" else r"\b")
        elif group and not inside:
            final = _group(pattern, m.end()) in FINAL
            out.append(group if engine != "spark" else f"{group}+" if final else f"){{{int(group[1] == '+')},{MOST}}}")
        elif special and not inside:
            out.append(r"[^\n\r\x{2028}\x{2029}]" if special == "." else r"\z")
        elif opens and inside:
            out.append(r"\[")
        else:
            inside = True if opens else False if closes else inside
            out.append(m[0])
    return (f"(?{flags})" if flags else "") + "".join(out)


def _group(pattern: str, end: int) -> str:
    """The group whose repetition ends there, from its opening parenthesis."""
    opened, inside = [], False
    for m in _TOKEN.finditer(pattern, 0, end):
        if m[0] == "[" and not inside:
            inside = True
        elif m[0] == "]":
            inside = False
        elif not inside and m[0] == "(":
            opened.append(m.start())
        elif not inside and m[0][0] == ")":
            start = opened.pop()
    return pattern[start:end]


def check(pattern: str) -> str:
    """``pattern``, if it can be parsed; a bad one fails here and not in a running query."""
    try:
        _parser.parse(pattern)
    except re.error as e:
        raise ConfigurationError(f"bad pattern {pattern!r}: {e}") from e
    return pattern


def _runs(tree) -> list[frozenset[str]]:
    """Sets of strings of which every match of the sequence holds at least one."""
    found, run = [], ""
    for op, value in tree:
        if op is _constants.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if op is _constants.SUBPATTERN:
            found += _runs(value[-1])
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0] >= 1:
            found += _runs(value[2])
        elif op is _constants.IN and all(o is _constants.LITERAL and v > 127 for o, v in value):
            found.append(frozenset(chr(v).lower() for _, v in value))
        elif op is _constants.BRANCH:
            each = [_best(_runs(x)) for x in value[1]]
            if all(each):
                found.append(frozenset().union(*each))
    return [*found, frozenset([run])] if run else found


def _width(word: str) -> int:
    """How telling a string is: its length, and a character outside ASCII as much as two."""
    return len(word.encode())


def _best(sets: list[frozenset[str]]) -> frozenset[str]:
    return max(sets, key=lambda s: (min(map(_width, s)), -len(s)), default=frozenset())


@lru_cache(None)
def gates(pattern: str) -> tuple[frozenset[str], ...]:
    """Sets of small-letter strings: any match holds, in small letters, one of each. The most telling set first; none if there is none worth a look."""
    worth = {s for s in _runs(_parser.parse(pattern)) if s and min(map(_width, s)) >= 2}
    return tuple(sorted(worth, key=lambda s: (-min(map(_width, s)), len(s), sorted(s))))


def gate(pattern: str) -> frozenset[str]:
    """The most telling set of ``gates``; empty if there is none."""
    return next(iter(gates(pattern)), frozenset())
