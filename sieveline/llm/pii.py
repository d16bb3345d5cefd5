"""Surrogates for personal data.

Detected entities get keyed replacements of the same type and form: HMAC-SHA256 of (type, entity,
attempt) drives a draw that keeps lengths, grouping, letter case, the country code of a phone number,
the check digit of an IBAN or card (a card is an issuer's digit and a right check digit, or groups of four), the reach (private or public) of an address,
the digits of the script a number was written in, and for people the gender, the script and the format
of the name.

People are found by titles, by cues ("my name is", "Contact:"), by a common given name before another
capitalised word, and by the end of a family name after one; in Han and Arabic script by surname and
given characters after a cue or before a title, and by given names. Given and family names are
entities of their own, so a full name and a bare surname agree. A title tells the gender of its given name;
an untitled name has the gender of the lists, or else the only one that titles in the corpus give it.

The same entity has the same surrogate everywhere (coreference; form and case are normalised before
hashing). Distinctness is checked over the whole corpus: all distinct entities with their surrogates
form a table; where two entities share a surrogate, or a surrogate is itself an entity of the corpus,
all but one move to their next attempt, until none is left. Listed given names are permuted among
themselves, so they never collide. From attempt WIDE on surrogates get longer and may equal an entity of the
corpus, so the rounds end even where a corpus has used up all forms of a type. Entities that moved are few;
documents that hold one get its attempt by a join (broadcast behind a count, else by shuffle).

Two passes over the texts (collect entities, rewrite); texts are moved only if the table of documents
with moved entities is too large to broadcast. Every expression starts at one place of a run only, so
time is linear in the text: lines of a megabyte without a blank cost what others do.

Defined cases: a null text stays null; an empty text stays; documents without entities are
unchanged to the byte; rows that repeat get equal results; a null doc_id is a value like others; texts
are taken whole whatever their length; entities that tie for a surrogate keep it in order of attempt,
entity and gender; decimal digits of every script count as digits; an empty table gives an empty result;
extra columns pass through, whatever their names, but names starting with ``__p_`` are reserved.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import sys
import unicodedata
from bisect import bisect_left
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import names as N
from .common import chunks, lean, read, small, string_buffer, sums, written

#: Default key; production passes its own.
KEY = b"sieveline surrogate key"
#: From this attempt on a surrogate is one place longer each time.
WIDE = 12

_TITLES = {t: g for g, ts in N.TITLES.items() for t in ts}
_TITLES |= {t.upper(): _TITLES[t] for t in N.CAPITAL}
_GENDER: dict[str, str] = {}
for (_, _g), _names in N.GIVEN.items():
    for _n in _names:
        _GENDER[_n.lower()] = _g if _GENDER.get(_n.lower(), _g) == _g else "n"
_PLACE = frozenset(N.PLACE)
_SALUTES = frozenset("dear liebe lieber cher chère querido querida estimado estimada".split())
_END = tuple(N.FAMILY_END)
_CUES = tuple(N.CUES)
_CUE = re.compile(rf"(?:^|\W)(?:{'|'.join(map(re.escape, N.CUES))})$")

_CAPITAL = "[A-ZÀ-ÖØ-ÞĀ-ſΆ-ΫЀ-Я]"
_NAME = rf"{_CAPITAL}[^\W\d_]*+(?:['’\-][^\W\d_]++)*+"
_WORDS = re.compile(rf"(?<!\w){_NAME}")
#: Two or more capitalised words, perhaps with particles; the look behind comes after the capital, so a scan skips to one.
_RUN = re.compile(rf"{_CAPITAL}(?<!\w\w)[^\W\d_]*+(?:['’\-][^\W\d_]++)*+(?:\.?[ \u00a0](?:(?:{'|'.join(N.PARTICLES)})[ \u00a0]){{0,2}}+{_NAME})++")
_HAN_CHAR = "[\u4e00-\u9fff]"
_HAN_NAME = f"(?P<{{0}}>{'|'.join(N.HAN_DOUBLE)}|[{N.HAN_FAMILY}])(?P<{{1}}>{{2}})"
_HAN_GIVENS = f"[{''.join(N.HAN_GIVEN.values())}]{{1,2}}"
_HAN = re.compile(f"(?:{N.HAN_CUES})\\s?{_HAN_NAME.format('f1', 'g1', _HAN_CHAR + '{1,2}')}(?!{_HAN_CHAR})|{_HAN_NAME.format('f2', 'g2', _HAN_CHAR + '{0,2}?')}(?P<t>{'|'.join(N.HAN_TITLES)})|(?<!{_HAN_CHAR}){_HAN_NAME.format('f3', 'g3', _HAN_GIVENS)}(?!{_HAN_CHAR})")
_ARABIC_WORD = "[\u0621-\u064a]{2,}+"
_ARABIC = re.compile(f"(?<!\\w)(?:(?P<t>{'|'.join(sorted(N.ARABIC_TITLES, key=len, reverse=True))}) |(?:{N.ARABIC_CUES}) ?)(?P<a>{_ARABIC_WORD})(?: (?P<b>{_ARABIC_WORD}))?|(?<!\\w)(?P<g>{'|'.join(sorted(N.GIVEN['arabic', 'm'] + N.GIVEN['arabic', 'f'], key=len, reverse=True))}) (?P<f>{_ARABIC_WORD})")
_HAN_SEEN, _ARABIC_SEEN = re.compile(_HAN_CHAR), re.compile("[\u0621-\u064a]")

_DIGITAL = re.compile(
    "|".join(
        (
            r"(?P<EMAIL>(?<![\w.%+\-])[\w.%+\-]++@[^\W_](?:[^\W_]|-)*+(?:\.(?:[^\W_]|-)++)++)",
            r"(?P<MAC>(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:]))",
            r"(?P<IBAN>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
            r"(?P<SECRET>(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?:sk|pk|ghp|gho|xoxb|AKIA)[A-Za-z0-9_\-]{16,}+)(?![0-9A-Za-z]))",
            r"(?P<IP>(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9]))",
            r"(?P<PHONE>(?<![\w+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![\w(])\(?[0-9]{3}\)?[ .\-][0-9]{3}[.\-][0-9]{4}(?![0-9]))",
            r"(?P<SSN>(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-]))",
            r"(?P<CARD>(?<![0-9.])(?:[0-9][ \-]?){12,18}[0-9](?![0-9]))",
        )
    )
)
#: A type with blanks in it is no longer than this; what starts in a window ends this far behind it.
REACH = 100
#: The country code of an international number; empty for others.
_COUNTRY = re.compile(r"(?:\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}))?")
#: Digits or an at sign: without one no pattern of _DIGITAL can match.
_MARK = np.zeros(256, bool)
_MARK[[64, *range(48, 58)]] = True
#: First bytes of characters of scripts with digits or names of their own: without one there are none.
_OTHER = np.zeros(256, bool)
_OTHER[[*range(0xD8, 0xE2), *range(0xE4, 0x100)]] = True


@cache
def _digits() -> tuple[re.Pattern, dict[int, int]]:
    """An expression for decimal digits outside ASCII, and what makes ASCII of them."""
    table = {c: 48 + unicodedata.decimal(chr(c)) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"}
    return re.compile(f"[{''.join(map(chr, table))}]"), table


def script(name: str) -> str:
    c = ord(name[0])
    if 0x400 <= c < 0x530:
        return "cyrillic"
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return "greek"
    return "arabic" if 0x600 <= c < 0x700 else "han" if 0x4E00 <= c < 0xA000 else "latin"


def normal(kind: str, raw: str) -> str:
    """What makes two mentions the same entity; ``raw`` has ASCII digits."""
    if kind == "EMAIL":
        return raw.lower()
    if kind == "SECRET":
        return raw.lower() if re.fullmatch("[0-9A-Fa-f]+", raw) else raw
    if kind in ("GIVEN", "FAMILY"):
        return raw[:1].upper() + raw[1:].lower()
    if kind == "IP":
        return ".".join(str(int(x)) for x in raw.split("."))
    return re.sub(r"[^0-9A-Za-z+]", "", raw).upper()


def _card(raw: str) -> bool:
    """Whether digits are a card number: an issuer's first digit and a right check digit, or groups of four."""
    return re.fullmatch(r"[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}", raw) is not None or raw[0] in "23456" and luhn(re.sub("[^0-9]", "", raw))


def _digital(text: str, windows: list[tuple[int, int]]) -> list[tuple[int, int, str, str, str]]:
    out = []
    for at, end in windows:
        most = end + REACH
        while at < end and (m := _DIGITAL.search(text, at, most)) and m.start() < end:
            kind, s, e = m.lastgroup, m.start(), m.end()
            at = e
            if kind == "EMAIL":
                s += len(m[0]) - len(m[0].lstrip("._%+-"))
                if text[s] == "@":
                    continue
            elif kind == "SECRET" and not any(map(str.isdigit, m[0])) or kind == "CARD" and not _card(m[0]):
                continue
            out.append((s, e, kind, normal(kind, text[s:e]), ""))
    return out


def _runs(text: str) -> list[list[tuple[int, int, str]]]:
    """Mentions of people as their parts: (start, end, gender) of given names, "" of the family name."""
    out = []
    for run in _RUN.finditer(text):
        words = [m.span() for m in _WORDS.finditer(text, *run.span())]
        said = [text[s:e] for s, e in words]
        low = [w.lower() for w in said]
        n = len(words)
        # "M" is a title before a stop only
        title = [None if w == "M" and text[e : e + 1] != "." else _TITLES.get(w) for w, (_, e) in zip(said, words)]
        # a stop parts words, unless after a title or an initial
        joined = [text[words[i][1]] != "." or title[i] or len(said[i]) == 1 for i in range(n - 1)] + [False]
        fit = [len(w) > 1 and x not in _PLACE and not t and w[0].isupper() for w, x, t in zip(said, low, title)]
        i = 0
        while i < n:
            gender, j, cue = None, i, False
            while j < n - 1 and joined[j] and (title[j] or low[j] in _SALUTES):
                g = title[j]
                gender = g if gender in (None, "n") and g else gender or ""
                j += 1
            titled = bool(gender)
            cue = gender == ""
            if j == 0 and not titled:
                before = text[max(0, words[0][0] - 40) : words[0][0]].rstrip().lower()
                cue = before.endswith(_CUES) and _CUE.search(before) is not None
            if not fit[j]:
                i = j + 1
                continue
            # the name: given names and initials, then the family name
            k = j
            listed = low[j] in _GENDER
            if joined[j] and (len(said[j + 1]) == 1 or fit[j + 1]):
                k = j + 1
                while k < n - 1 and joined[k] and (len(said[k]) == 1 or ((low[k] in _GENDER or cue and k < j + 2) and fit[k + 1])):
                    k += 1
            whole = k > j and fit[k]
            if whole and not (titled or cue or listed):
                ahead = text[: words[j][0]].rstrip()[-1:] if j == 0 else " "
                whole = j == 0 and len(said[j]) > 2 and not said[j].isupper() and len(said[k]) > 4 and low[k].endswith(_END) and bool(ahead) and ahead not in ".!?:;•*-" and text[words[j][0] - 1] == " "
            elif not whole:
                k = j
                whole = titled or cue and listed
            if not whole:
                i = j + 1
                continue
            parts = []
            for x in range(j, k + 1):
                if len(said[x]) == 1:
                    continue
                if x == k and (k > j or not listed):
                    parts.append((*words[x], ""))
                else:
                    g = gender if gender in ("m", "f") else _GENDER.get(low[x], "u")
                    parts.append((*words[x], g))
            if parts:
                out.append(parts)
            i = k + 1
    return out


def _others(text: str) -> list[list[tuple[int, int, str]]]:
    """Mentions in Han and Arabic script."""
    out = []
    if _HAN_SEEN.search(text):
        for m in _HAN.finditer(text):
            k = "123"[[m["f1"], m["f2"], m["f3"]].index(next(x for x in (m["f1"], m["f2"], m["f3"]) if x))]
            g = m[f"g{k}"]
            gender = N.HAN_TITLES.get(m["t"] or "", "u")
            kinds = {s for s in "mf" if any(c in N.HAN_GIVEN[s] for c in g)}
            gender = gender if gender in "mf" else kinds.pop() if len(kinds) == 1 else "n"
            out.append([(*m.span(f"f{k}"), "")] + ([(*m.span(f"g{k}"), gender)] if g else []))
    if _ARABIC_SEEN.search(text):
        for m in _ARABIC.finditer(text):
            if m["g"]:
                out.append([(*m.span("g"), _GENDER.get(m["g"], "u")), (*m.span("f"), "")])
                continue
            gender = N.ARABIC_TITLES.get(m["t"] or "", "u")
            gender = gender if gender in "mf" else _GENDER.get(m["a"], "u")
            if m["b"]:
                out.append([(*m.span("a"), gender), (*m.span("b"), "")])
            else:
                out.append([(*m.span("a"), gender if m["a"] in _GENDER else "")])
    return out


def detect(text: str, windows: list[tuple[int, int]] | None = None, other: bool = True) -> tuple[list[tuple[int, int, str, str, str]], int]:
    """((start, end, type, entity, gender) from left to right, none overlapping; how many mentions). ``windows``:
    where entities with digits or an at sign may start, if known; ``other``: whether other scripts may occur."""
    plain = text
    if other and not text.isascii() and _digits()[0].search(text):
        plain, windows = text.translate(_digits()[1]), None
    out = _digital(plain, [(0, len(text))] if windows is None else windows)
    count = len(out)
    starts, ends = [x[0] for x in out], [x[1] for x in out]
    for parts in _runs(text) + (_others(text) if other and not text.isascii() else []):
        s, e = min(x[0] for x in parts), max(x[1] for x in parts)
        at = bisect_left(ends, s + 1)
        if at < len(ends) and starts[at] < e:
            continue
        count += 1
        for a, b, g in parts:
            kind = "GIVEN" if g else "FAMILY"
            out.append((a, b, kind, normal(kind, text[a:b]), g))
    out.sort()
    return out, count


class Draw:
    """A keyed stream of numbers."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.seed, self.n, self.left = key, f"{kind}\0{entity}\0{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            self.left += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        v, self.left = int.from_bytes(self.left[:8], "big"), self.left[8:]
        return v * n >> 64

    def pick(self, xs):
        return xs[self.below(len(xs))]


def luhn(digits: str) -> bool:
    total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@cache
def _cycle(key: bytes, pool: tuple[str, ...]) -> dict[str, str]:
    """A keyed permutation of the pool that leaves none in its place."""
    order = sorted(pool, key=lambda x: hmac.new(key, x.encode(), hashlib.sha256).digest())
    return dict(zip(order, order[1:] + order[:1]))


@cache
def pool(s: str, gender: str) -> tuple[str, ...]:
    """Given names of a script and gender."""
    if s == "han":
        return tuple(N.HAN_GIVEN[gender] + (N.HAN_GIVEN["n"] if gender != "n" else ""))
    some = N.GIVEN.get((s, gender))
    return tuple(dict.fromkeys(some if some else N.GIVEN[s, "m"] + N.GIVEN[s, "f"]))


def _given(key: bytes, d: Draw, entity: str, gender: str, attempt: int) -> str:
    s, g = script(entity), gender if gender in ("m", "f") else "n"
    xs = pool(s, g)
    if s == "han":
        return "".join(d.pick(xs) for _ in range(len(entity) + attempt // 2))
    if attempt == 0 and entity in xs and len(xs) > 1:
        return _cycle(key, xs)[entity]
    return "-".join(d.pick(xs) for _ in range(2 + attempt // 3))


def _family(key: bytes, d: Draw, entity: str, attempt: int) -> str:
    s = script(entity)
    if s == "han":
        xs = tuple(N.HAN_FAMILY) if len(entity) == 1 else tuple(N.HAN_DOUBLE)
        return _cycle(key, xs)[entity] if attempt == 0 and entity in xs else "".join(d.pick(N.HAN_FAMILY) for _ in range(2 + attempt // 2))
    a, b, c = N.SYLLABLES[s]
    if s == "arabic":
        return a[0] + "".join(d.pick(b) for _ in range(2 + (len(entity) > 6) + attempt)) + d.pick(c)
    out = d.pick(a) + d.pick(b) + "".join(d.pick(a).lower() + d.pick(b) for _ in range((len(entity) > 6) + attempt)) + d.pick(a).lower() + d.pick(c)
    # Slavic family names of women end in a vowel
    return out + ("а" if s == "cyrillic" and entity.endswith(("ва", "на", "ая")) and out.endswith(("в", "н")) else "")


def surrogate(key: bytes, kind: str, entity: str, gender: str, attempt: int) -> str:
    """The normal form of the replacement."""
    d = Draw(key, kind, f"{entity}\0{gender}" if kind == "GIVEN" else entity, attempt)
    if kind == "GIVEN":
        return _given(key, d, entity, gender, attempt)
    if kind == "FAMILY":
        return _family(key, d, entity, attempt)
    alike = lambda c: str(d.below(10)) if c.isdigit() else d.pick("ABCDEFGHJKLMNPQRSTUVWXYZ") if c.isalpha() else c
    if kind == "EMAIL":
        local, _, _ = entity.partition("@")
        name = "".join(str(d.below(10)) if c.isdigit() else d.pick("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in local)
        tail = "".join(d.pick("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(6 + attempt))
        return f"{name}@{tail}.example.{d.pick(('com', 'net', 'org'))}"
    if kind == "IP":
        private = ipaddress.ip_address(entity).is_private
        if attempt >= WIDE:
            return f"{'fd00' if private else '2001:db8'}::" + ":".join(f"{d.below(65536):x}" for _ in range(min(4, attempt - WIDE + 2)))
        while True:
            v = f"10.{d.below(256)}.{d.below(256)}.{1 + d.below(254)}" if private else f"{1 + d.below(223)}.{d.below(256)}.{d.below(256)}.{1 + d.below(254)}"
            if ipaddress.ip_address(v).is_private == private:
                return v
    entity += "0" * max(0, attempt - WIDE + 1)
    if kind == "MAC":
        return "02" + "".join(d.pick("0123456789ABCDEF") for _ in entity[2:])
    if kind == "SECRET":
        if re.fullmatch("[0-9a-f]+", entity):
            return "".join(d.pick("0123456789abcdef") for _ in entity)
        head = re.match(r"sk|pk|ghp|gho|xoxb|AKIA", entity)[0]
        return head + "".join(str(d.below(10)) if c.isdigit() else d.pick("abcdefghijklmnopqrstuvwxyz") if c.islower() else d.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isupper() else c for c in entity[len(head) :])
    if kind == "CARD":
        body = "".join(str(d.below(10)) for _ in entity[:-1])
        right = next(c for c in "0123456789" if luhn(body + c))
        return body + (right if luhn(entity[: len(entity) - max(0, attempt - WIDE + 1)]) else str((int(right) + 1 + d.below(9)) % 10))
    if kind == "IBAN":
        body = "".join(map(alike, entity[4:]))
        if _iban_ok(entity[: len(entity) - max(0, attempt - WIDE + 1)]):
            n = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
            return f"{entity[:2]}{98 - n % 97:02d}{body}"
        return entity[:2] + "".join(str(d.below(10)) for _ in range(2)) + body
    if kind == "PHONE":
        keep = len(_COUNTRY.match(entity)[0])
        return entity[:keep] + "".join(map(alike, entity[keep:]))
    return "".join(map(alike, entity))


def shaped(kind: str, raw: str, new: str) -> str:
    """The replacement in the form of the mention: its grouping, letter case and digits."""
    letters = [c for c in raw if c.isalpha()]
    if kind in ("GIVEN", "FAMILY"):
        return new.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else new
    if kind in ("EMAIL", "SECRET"):
        new = new.upper() if letters and not any(c.islower() for c in letters) else new
    elif kind != "IP":
        if kind == "MAC" and not any(c.isupper() for c in letters):
            new = new.lower()
        it = iter(new)
        new = "".join(next(it, "") if c.isalnum() or c == "+" else c for c in raw) + "".join(it)
    if not raw.isascii():
        zero = next((ord(c) - unicodedata.decimal(c) for c in raw if not c.isascii() and c.isdecimal()), 48)
        new = new if zero == 48 else new.translate({48 + k: zero + k for k in range(10)})
    return new


def _windows(part: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int]]]:
    """Ranges of characters of each text in which entities with digits or an at sign start: runs without white space that
    hold one, those at most REACH apart together."""
    docs = len(at) - 1
    out: list[list[tuple[int, int]]] = [[] for _ in range(docs)]
    marks = np.flatnonzero(_MARK[part])
    if not len(marks):
        return out
    solid = part > 32
    first = np.zeros(len(part) + 1, bool)
    first[at] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:-1]
    run = np.unique(np.searchsorted(np.flatnonzero(begin), marks, "right") - 1)
    start, end = np.flatnonzero(begin)[run], np.flatnonzero(stop)[run] + 1
    doc = np.searchsorted(at, start, "right") - 1
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] - end[:-1] > REACH) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    start, end, doc = start[head], end[np.append(head[1:], len(end)) - 1], doc[head]
    chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    base = chars[at[doc]]
    for d, s, e in zip(doc.tolist(), (chars[start] - base).tolist(), (chars[end] - base).tolist()):
        out[d].append((s, e))
    return out


def _detected(off: np.ndarray, data: np.ndarray):
    """(number, text, entities, mentions) of each of consecutive texts that has some."""
    part = data[off[0] : off[-1]]
    at = off - off[0]
    raw = part.tobytes()
    ends = at.tolist()
    for k, (windows, other) in enumerate(zip(_windows(part, at), (sums(_OTHER[part], at) > 0).tolist())):
        text = raw[ends[k] : ends[k + 1]].decode()
        got, count = detect(text, windows, other)
        if got:
            yield k, text, got, count


_ENTITY = "__p_kind string, __p_entity string, __p_gender string"
_KEY = ["__p_kind", "__p_entity", "__p_gender"]


def _entities(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, type, entity, gender)."""

    def run(batches):
        for b in batches:
            off, data = string_buffer(b.column(1))
            rows = {(i + k, *x[2:]): None for i, j in chunks(off) for k, _, got, _ in _detected(off[i : j + 1], data) for x in got}
            at, kind, entity, gender = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(x, pa.string()) for x in (kind, entity, gender)]], names=["doc_id", *_KEY])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_ENTITY}").distinct()


def _with_surrogate(table: DataFrame, key: bytes) -> DataFrame:
    @F.pandas_udf("string")
    def made(kind, entity, gender, attempt):
        import pandas as pd

        return pd.Series([surrogate(key, *x) for x in zip(kind, entity, gender, attempt)], dtype=object)

    return table.withColumn("surrogate", made(*_KEY, "attempt"))


def genders(found: DataFrame) -> DataFrame:
    """(type, entity, g) of given names without a gender of their own, where titles give them one only."""
    told = found.where("__p_kind = 'GIVEN'").groupBy("__p_kind", "__p_entity").agg(F.max(F.col("__p_gender") == "u").alias("u"), F.max(F.col("__p_gender") == "m").alias("m"), F.max(F.col("__p_gender") == "f").alias("f"))
    return told.where("u AND m <> f").select("__p_kind", "__p_entity", F.when(F.col("m"), "m").otherwise("f").alias("g"))


def attempts(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(type, entity, gender, attempt > 0) of the entities whose first surrogate collides."""
    base = found.select(*_KEY).distinct().withColumn("attempt", F.lit(0))
    table = written(_with_surrogate(base, key), "pii-surrogates")
    # a given name may be the surrogate of another, since all of them are replaced, but not of itself
    original = table.select("__p_kind", F.col("__p_entity").alias("surrogate")).distinct().withColumn("taken", F.lit(True))
    while True:
        w = W.partitionBy("__p_kind", "surrogate").orderBy("attempt", "__p_entity", "__p_gender")
        marked = table.withColumn("r", F.row_number().over(w)).join(original, ["__p_kind", "surrogate"], "left")
        taken = F.when(F.col("__p_kind").isin("GIVEN", "FAMILY") | (F.col("attempt") >= WIDE), F.col("surrogate") == F.col("__p_entity")).otherwise(F.col("taken").isNotNull())
        marked = written(marked.withColumn("bad", (F.col("r") > 1) | taken).select(*_KEY, "attempt", "surrogate", "bad"), "pii-marked")
        if marked.where("bad").isEmpty():
            return table.where("attempt > 0").select(*_KEY, "attempt")
        again = _with_surrogate(marked.where("bad").drop("surrogate", "bad").withColumn("attempt", F.col("attempt") + 1), key)
        table = written(marked.where("not bad").drop("bad").unionByName(again), "pii-surrogates")


def replaced(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, plus ``__p_n``, how many mentions were replaced."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    found = written(_entities(docs), "pii-entities")
    given = genders(found)
    settled = found.join(given, ["__p_kind", "__p_entity"], "left").withColumn("own", F.col("__p_gender"))
    settled = settled.withColumn("__p_gender", F.when(F.col("own") == "u", F.coalesce("g", F.lit("n"))).otherwise(F.col("own")))
    settled = written(settled.select("doc_id", *_KEY, "own"), "pii-settled")
    moved = attempts(settled, key)
    special = settled.select(*_KEY, "own").distinct().join(moved, _KEY, "left").where("attempt IS NOT NULL OR (own = 'u' AND __p_gender <> 'n')")
    special = written(special.select("__p_kind", "__p_entity", "own", F.col("__p_gender").alias("g"), F.coalesce("attempt", F.lit(0)).alias("attempt")), "pii-special")
    names = docs.columns
    at = names.index("text")
    if special.isEmpty():
        given = docs.withColumn("__p_moved", F.lit(None).cast("array<struct<k:string,e:string,o:string,g:string,a:int>>"))
    else:
        per = settled.select("doc_id", "__p_kind", "__p_entity", "own").join(small(special, "pii-special"), ["__p_kind", "__p_entity", "own"])
        per = per.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("__p_kind").alias("k"), F.col("__p_entity").alias("e"), F.col("own").alias("o"), F.col("g"), F.col("attempt").alias("a"))).alias("__p_moved"))
        per = small(per.withColumnRenamed("doc_id", "__p_doc"), "pii-documents")
        given = docs.join(per, docs["doc_id"].eqNullSafe(per["__p_doc"]), "left").drop("__p_doc")
    given = given.select(*names, "__p_moved")
    schema = StructType([*docs.schema.fields, StructField("__p_n", IntegerType())])

    def run(batches):
        for b in batches:
            col = b.column(at)
            off, data = string_buffer(col)
            moved = b.column(len(names))
            new: dict[int, str] = {}
            count = np.zeros(b.num_rows, np.int32)
            for i, j in chunks(off):
                for k, text, got, n in _detected(off[i : j + 1], data):
                    extra = {(x["k"], x["e"], x["o"]): x for x in (moved[i + k].as_py() or ())}
                    out, last = [], 0
                    for s, e, kind, entity, gender in got:
                        x = extra.get((kind, entity, gender))
                        made = surrogate(key, kind, entity, gender.replace("u", "n") if x is None else x["g"], 0 if x is None else x["a"])
                        out += [text[last:s], shaped(kind, text[s:e], made)]
                        last = e
                    new[i + k] = "".join(out) + text[last:]
                    count[i + k] = n
            if new:
                mask = np.zeros(b.num_rows, bool)
                mask[list(new)] = True
                col = pa.compute.replace_with_mask(col, pa.array(mask), pa.array([new[k] for k in sorted(new)], col.type))
            cols = b.columns[: len(names)]
            cols[at] = col
            yield pa.RecordBatch.from_arrays([*cols, pa.array(count)], names=[f.name for f in schema.fields])

    return given.mapInArrow(lean(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and the number of mentions."""
    return replaced(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("__p_n", "n_replaced")
