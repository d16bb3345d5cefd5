"""Pattern tables, read on the driver; all are small.

Regular expressions are kept in a short notation: ``%b`` an ASCII word boundary, ``%d`` a digit,
``%a`` a letter or digit, ``%u`` one of those or ``_`` or ``-``, ``%C`` upper case or digit, ``%l`` lower case or
digit, ``%h`` and ``%H`` hexadecimal in lower and in either case, ``%%`` a per cent sign.
"""

from __future__ import annotations

import base64
import re
from functools import cache
from pathlib import Path
from typing import NamedTuple

HERE = Path(__file__).parent
_CLASSES = {"d": "[0-9]", "a": "[0-9A-Za-z]", "u": "[-0-9A-Z_a-z]", "C": "[0-9A-Z]", "l": "[0-9a-z]", "h": "[0-9a-f]", "H": "[0-9A-Fa-f]", "b": "%b", "%": "%"}


class Pattern(NamedTuple):
    name: str
    entity_type: str
    category: str
    sensitivity: str
    confidence: float
    validator: str
    hints: tuple[str, ...]
    regex: str  # ``%b`` still stands for the boundary
    allow: tuple[str, ...] = ()  # a value with a match of one of these is a known false positive
    stop: tuple[str, ...] = ()  # placeholders of this pattern alone
    boost: tuple[str, ...] = ()  # words of a value that support the pattern, or speak against it
    suppress: tuple[str, ...] = ()


def required(node) -> set[str] | None:
    """Lower-case texts one of which every match of a parsed expression contains; None if none is certain."""
    best: set[str] | None = None
    run = ""

    def offer(x: set[str] | None) -> None:
        nonlocal best
        if x and (best is None or min(map(len, x)) > min(map(len, best))):
            best = x

    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg).lower()
            continue
        offer({run} if run else None)
        run = ""
        if name == "SUBPATTERN":
            offer(required(arg[3]))
        elif name == "BRANCH":
            parts = [required(x) for x in arg[1]]
            if all(parts):
                offer(set().union(*parts))
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            offer(required(arg[2]))
    offer({run} if run else None)
    return best


def digits(node) -> int:
    """How many digits every match holds at least."""
    n = 0
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            n += 48 <= arg <= 57
        elif name == "IN":
            n += all(str(o) in ("RANGE", "LITERAL") and 48 <= (a[0] if str(o) == "RANGE" else a) and (a[1] if str(o) == "RANGE" else a) <= 57 for o, a in arg)
        elif name == "SUBPATTERN":
            n += digits(arg[3])
        elif name == "BRANCH":
            n += min(digits(x) for x in arg[1])
        elif name == "MAX_REPEAT":
            n += arg[0] * digits(arg[2])
    return n


def parsed(regex: str):
    """The syntax tree of a pattern, for what must hold of all its matches."""
    from re import _parser

    return _parser.parse(("(?i)" if "(?i)" in regex else "") + regex.replace("(?i)", "").replace("%b", r"\b"), re.ASCII)


@cache
def screen(regex: str) -> tuple[int, int, tuple[str, ...]]:
    """(least length, least digits, lower-case texts one of which is there) of any match: cheap tests that
    spare most values the expression itself."""
    tree = parsed(regex)
    return tree.getwidth()[0], digits(tree), tuple(sorted(required(tree) or ()))


def _rows(name: str) -> list[list[str]]:
    return [line.split("\t") for line in (HERE / name).read_text().splitlines() if line]


def _lines(name: str) -> list[str]:
    return [line for line in (HERE / name).read_text().splitlines() if line]


def expand(short: str) -> str:
    return re.sub("%(.)", lambda m: _CLASSES[m[1]], short)


@cache
def content_patterns() -> tuple[Pattern, ...]:
    return tuple(Pattern(n, e, c, s, float(k), v, tuple(h.split(",")) if h else (), expand(r)) for n, e, c, s, k, v, h, r in _rows("content.tsv"))


@cache
def column_variants() -> dict[str, tuple[str, str, str, float]]:
    """Normalised column name -> (entity type, category, sensitivity, confidence); the first wins."""
    out: dict[str, tuple[str, str, str, float]] = {}
    for e, c, s, k, names in _rows("columns.tsv"):
        for n in names.split():
            out.setdefault(re.sub("_+", "_", n.lower().replace("-", "_")).strip("_"), (e, c, s, float(k)))
    return out


@cache
def profile_rules() -> tuple[tuple[str, str, str, float, tuple[str, ...], tuple[str, ...]], ...]:
    """(entity type, category, sensitivity, confidence, regulations, patterns), first match wins."""
    full = lambda p: f"(?:^|_)(?:{p[1:].replace(' ', '|')})(?:_|$)" if p[0] == "~" else p[1:]
    return tuple((e, c, s, float(k), tuple(r.split(",")), tuple(map(full, ps))) for e, c, s, k, r, *ps in _rows("profile.tsv"))


@cache
def key_names() -> tuple[tuple[str, str, float, str, str], ...]:
    """(key pattern, match type, score, tier, subtype)."""
    out = [(p, m, float(s), t, b) for m, s, t, b, ps in _rows("keys.tsv") for p in ps.split()]
    # generic names, best known of all
    for score, tier, subtype, names in (
        (0.95, "definitive", "API_KEY", "api_key apikey api_secret secret_key access_key client_secret"),
        (0.95, "definitive", "OPAQUE_SECRET", "password passwd db_password"),
        (0.95, "definitive", "PRIVATE_KEY", "private_key"),
        (0.8, "strong", "OPAQUE_SECRET", "secret credential auth_token access_token refresh_token bearer token"),
        (0.6, "contextual", "OPAQUE_SECRET", "auth signature session_key"),
    ):
        out += [(n, "substring", score, tier, subtype) for n in names.split()]
    out += [("pwd", "word_boundary", 0.9, "strong", "OPAQUE_SECRET"), ("key", "suffix", 0.5, "contextual", "OPAQUE_SECRET")]
    return tuple(sorted(out, key=lambda x: (-x[2], x[0], x[1])))


def decode(value: str) -> str:
    """A literal kept as ``xor:`` (every byte with 0x5A, then base-64) or ``b64:``; others as they are."""
    kind, _, body = value.partition(":")
    if kind == "b64":
        return base64.b64decode(body).decode()
    return bytes(b ^ 0x5A for b in base64.b64decode(body)).decode() if kind == "xor" else value


@cache
def stopwords() -> list[str]:
    return sorted({decode(w).strip().lower() for w in _lines("stopwords.txt")})


@cache
def placeholders() -> list[str]:
    return sorted(set(_lines("placeholders.txt")))


@cache
def content_words() -> tuple[str, ...]:
    return tuple(sorted({w for line in _lines("words.txt") for w in line.split()}))
