"""Two SQL dialects for one definition: the engine's own and the one its results are held against."""

from __future__ import annotations

import re
from functools import cache
from re import _parser

#: A word boundary over ASCII letters, digits and underscore, as linear-time engines have it; the
#: Java engine's own would also count accented letters.
ASCII_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def _word(code: int) -> bool:
    return code < 128 and (chr(code).isalnum() or code == 95)


def _edge(tree, last: bool) -> bool:
    """Whether the first (or last) character of every match is a letter, digit or underscore."""
    items = [x for x in tree if str(x[0]) != "AT"]
    for op, arg in reversed(items) if last else items:
        name = str(op)
        if name == "LITERAL":
            return _word(arg)
        if name == "IN":
            return all((str(o) == "RANGE" and all(map(_word, range(a[0], a[1] + 1)))) or (str(o) == "LITERAL" and _word(a)) for o, a in arg)
        if name == "SUBPATTERN":
            return _edge(arg[3], last)
        if name == "BRANCH":
            return all(_edge(x, last) for x in arg[1])
        if name == "MAX_REPEAT":
            if not _edge(arg[2], last):
                return False
            if arg[0]:
                return True
            continue
        return False
    return False


@cache
def plain_boundaries(p: str) -> str:
    """``%b`` for the Java engine. Next to a character that is always a word character, the boundary at an
    end of the pattern is one look at the other side, which is many times faster."""
    head, tail = "", ""
    flag = "(?i)" if p.startswith("(?i)") else ""
    body = p[len(flag) :]
    if "|" not in re.sub(r"\(.*\)|\[[^\]]*\]", "", body):
        core = body.removeprefix("%b").removesuffix("%b")
        if core.count("(") - core.count("\\(") >= 0 and "(?i)" not in core and "%b" not in core:
            try:
                tree = _parser.parse(core, re.ASCII)
            except re.error:
                tree = None
            if tree is not None:
                if body.startswith("%b") and _edge(tree, False):
                    head, body = "(?<![0-9A-Za-z_])", body[2:]
                if body.endswith("%b") and _edge(tree, True):
                    body, tail = body[:-2], "(?![0-9A-Za-z_])"
    return flag + head + body.replace("%b", ASCII_BOUNDARY) + tail


class Dialect:
    """How the few functions that differ are written."""

    def __init__(self, spark: bool):
        self.spark = spark

    def text(self, s: str) -> str:
        """A string literal, backslashes as they stand."""
        if self.spark:
            return "r'" + s.replace("'", r"\x27") + "'" if "\\" in s else "'" + s.replace("'", "\\'") + "'"
        return "'" + s.replace("'", "''") + "'"

    def regex(self, p: str) -> str:
        """A pattern literal."""
        p = (plain_boundaries(p) if self.spark else p.replace("%b", r"\b")).replace("'", r"\x27")
        return f"r'{p}'" if self.spark else f"'{p}'"

    def like(self, v: str, p: str) -> str:
        return f"({v} RLIKE {self.regex(p)})" if self.spark else f"regexp_matches({v}, {self.regex(p)})"

    def replace(self, v: str, p: str, by: str = "") -> str:
        return f"regexp_replace({v}, {self.regex(p)}, {self.text(by)})" if self.spark else f"regexp_replace({v}, {self.regex(p)}, {self.text(by)}, 'g')"

    def all(self, v: str, p: str, group: int = 0) -> str:
        """All matches, as an array."""
        return f"regexp_extract_all({v}, {self.regex(p)}, {group})"

    def first(self, v: str, p: str, group: int = 0) -> str:
        """First match, empty without one."""
        return f"regexp_extract({v}, {self.regex(p)}, {group})"

    def size(self, a: str) -> str:
        return f"size({a})" if self.spark else f"len({a})"

    def chars(self, v: str) -> str:
        return f"split({v}, '')" if self.spark else f"string_split({v}, '')"

    def split(self, v: str, at: str) -> str:
        return f"split({v}, {self.regex(at)})" if self.spark else f"regexp_split_to_array({v}, {self.regex(at)})"

    def fn(self, args: str, body: str) -> str:
        return f"{f'({args})' if ',' in args else args} -> {body}" if self.spark else f"lambda {args}: {body}"

    def map(self, a: str, x: str, body: str) -> str:
        return f"transform({a}, {self.fn(x, body)})" if self.spark else f"list_transform({a}, {self.fn(x, body)})"

    def filter(self, a: str, x: str, body: str) -> str:
        return f"filter({a}, {self.fn(x, body)})" if self.spark else f"list_filter({a}, {self.fn(x, body)})"

    def sum(self, a: str) -> str:
        """Sum of an array of doubles."""
        return f"aggregate({a}, 0D, (a_, x_) -> a_ + x_)" if self.spark else f"coalesce(list_sum({a}), 0.0)"

    def fold(self, a: str, args: str, body: str) -> str:
        """An array of integers folded from 0; ``args``: the names of the state and the element."""
        return f"aggregate({a}, CAST(0 AS BIGINT), {self.fn(args, body)})" if self.spark else f"list_reduce(list_prepend(CAST(0 AS BIGINT), {a}), {self.fn(args, body)})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})" if self.spark else f"list_distinct({a})"

    def every(self, a: str, x: str, body: str) -> str:
        return f"forall({a}, {self.fn(x, body)})" if self.spark else f"(len(list_filter({a}, {self.fn(x, f'NOT ({body})')})) = 0)"

    def double(self, x: str) -> str:
        return f"CAST({x} AS DOUBLE)"

    def luhn(self, digits: str) -> str:
        if self.spark:
            return f"luhn_check({digits})"
        one = f"CAST(substr({digits}, length({digits}) - i, 1) AS INT)"
        return f"(list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {one} WHEN {one} > 4 THEN 2 * {one} - 9 ELSE 2 * {one} END)) % 10 = 0)"

    def any_in(self, v: str, words: list[str]) -> str:
        """Whether ``v`` is one of the words."""
        return f"{v} IN ({', '.join(self.text(w) for w in words)})"

    def contains(self, v: str, s: str) -> str:
        return f"contains({v}, {self.text(s)})"

    def explode(self, a: str) -> str:
        """One row for each element, in a select list."""
        return f"explode({a})" if self.spark else f"unnest({a})"

    def once(self, x: str) -> str:
        """A value of a select list that later filters do not compute again below it, together with all it is made of."""
        return f"explode(array({x}))" if self.spark else x

    def array(self, items) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def range(self, n: str) -> str:
        """1 .. n; empty for n < 1."""
        return f"(CASE WHEN {n} < 1 THEN array() ELSE sequence(1, {n}) END)" if self.spark else f"range(1, {n} + 1)"

    def joined(self, a: str, start: str, size: str, by: str) -> str:
        """``size`` elements from place ``start``, counted from 1, as one text."""
        return f"array_join(slice({a}, {start}, {size}), '{by}')" if self.spark else f"array_to_string(list_slice({a}, {start}, {start} + {size} - 1), '{by}')"

    def collect(self, v: str, order: str, most: int | None = None) -> str:
        """Aggregate: values in an order, at most so many."""
        if self.spark:
            a = f"transform(sort_array(collect_list(struct({order} AS o_, {v} AS v_))), x_ -> x_.v_)"
            return f"slice({a}, 1, {most})" if most else a
        a = f"list({v} ORDER BY {order})"
        return f"list_slice({a}, 1, {most})" if most else a

    def sorted_set(self, v: str) -> str:
        """Aggregate: distinct values in order."""
        return f"sort_array(collect_set({v}))" if self.spark else f"coalesce(list_sort(list(DISTINCT {v}) FILTER ({v} IS NOT NULL)), [])"

    def flat_set(self, a: str) -> str:
        """Aggregate: distinct elements of arrays, in order."""
        return f"sort_array(array_distinct(flatten(collect_list({a}))))" if self.spark else f"list_sort(list_distinct(flatten(list({a}))))"

    def overlap(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})" if self.spark else f"list_has_any({a}, {b})"

    def texts(self, items) -> str:
        """An array of literals."""
        return self.array([self.text(x) for x in items]) if items else ("CAST(array() AS array<string>)" if self.spark else "CAST([] AS VARCHAR[])")

    def values(self, rows, names) -> str:
        """A small table of literals."""
        lit = lambda x: "NULL" if x is None else self.text(x) if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)
        return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v_({', '.join(names)}))"


SPARK, DUCK = Dialect(True), Dialect(False)
