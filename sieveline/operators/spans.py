"""Secrets in free text: candidates with offsets, filters and scores, one finding for each span.

An Arrow function finds candidates (there is no built-in that gives the place of every match): key
blocks, pattern matches, assignments and bare tokens. All filtering, scoring, overlap removal and
redaction are expressions over the array of candidates of a row, so texts are never shuffled and the same
plan runs on streams. Offsets count characters from 0, ends are exclusive.

A null text has null findings; an empty one has none.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import validators
from ..functions.dialect import SPARK
from ..patterns import content_patterns, screen, stopwords

CANDIDATE = "array<struct<kind:string,name:string,key:string,value:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("key", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

#: Each expression starts at one place of a run, and no part gives back what it took: time is linear in the text.
_KEY = r"(?<![A-Za-z0-9_])(?P<key>[A-Za-z_]\w*+)"
_ENV = re.compile(r"(?ams)^[^\S\n]*+(?:export\s++)?(?P<key>[A-Za-z_]\w*+)\s*+=\s*+(?:(?P<q>[\x22\x27])(?P<inner>(?:(?!(?P=q)).){0,500}+)(?P=q)|(?P<bare>[^\s,{}\[\]()]++))[^\S\n]*+$")
_CODE = re.compile(rf"(?as){_KEY}\s*+(?::=|[:=])\s*+(?P<q>[\x22\x27])(?P<inner>(?:(?!(?P=q)).){{1,500}}+)(?P=q)")
_PEM = re.compile(r"(?a)-----(?P<side>BEGIN|END)\s++(?P<what>\w(?:\w|\s)*+)-----")
_TOKEN = re.compile(r"\S{16,}")
_EDGE_LEFT, _EDGE_RIGHT = "\"'`", "\"'`,.;:!?)]}"


@cache
def _scanner():
    """(compiled patterns, automaton of required literals, patterns that have none)."""
    import ahocorasick

    compiled, always = [], []
    auto = ahocorasick.Automaton()
    need: dict[str, list[int]] = {}
    for p in content_patterns():
        if p.category != "Credential" or p.hints:
            continue
        # these regular expressions keep their flag in front and use ASCII classes
        source = p.regex.replace("%b", r"\b")
        at = len(compiled)
        compiled.append((p.name, re.compile(source if not source.startswith(r"\b(?i)") else "(?i)" + source.replace("(?i)", ""), re.ASCII)))
        found = screen(p.regex)[2]
        if found and min(map(len, found)) < 3:
            found = ()
        for x in found:
            need.setdefault(x, []).append(at)
        if not found:
            always.append(at)
    for x, ids in need.items():
        auto.add_word(x, tuple(ids))
    auto.make_automaton()
    return compiled, auto, always


def key_blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, label) of blocks between a BEGIN and the next END of the same label."""
    out: list[tuple[int, int, str]] = []
    marks = [(m["side"], m["what"], m.start(), m.end()) for m in _PEM.finditer(text)]
    ends: dict[str, list[tuple[int, int]]] = {}
    for side, what, start, end in marks:
        if side == "END":
            ends.setdefault(what, []).append((start, end))
    last = 0
    for side, what, start, end in marks:
        if side == "BEGIN" and start >= last and what in ends:
            at = bisect_left(ends[what], (end, 0))
            if at < len(ends[what]):
                last = ends[what][at][1]
                out.append((start, last, what.strip().upper()))
    return out


def _trace_lines(text: str, places: list[int]) -> list[bool]:
    """Whether the lines of ascending places belong to a stack trace or error message."""
    out, end, hit = [], -1, False
    for at in places:
        if at > end:
            start, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
            end = len(text) if end < 0 else end
            hit = T.TRACE_LINE.match(text[start:end].strip()) is not None
        out.append(hit)
    return out


def candidates(text: str) -> list[tuple]:
    """(kind, name, key, value, start, end) of everything that may be a secret."""
    out: list[tuple] = []
    blocks = []
    low = text.lower()
    if "-----begin" in low:
        for start, end, what in key_blocks(text):
            blocks.append((start, end))
            if "PRIVATE" in what:
                # the label stands for the value: nothing of the key is shown
                out.append(("pem", what, None, f"-----BEGIN {what}-----", start, end))
    starts = [a for a, _ in blocks]
    inside = lambda at: bool(blocks) and (k := bisect_right(starts, at) - 1) >= 0 and at < blocks[k][1]
    compiled, auto, always = _scanner()
    tokens = list(_TOKEN.finditer(text))
    ids = {k for _, ks in auto.iter(low) for k in ks}
    if tokens:
        ids.update(always)
    for k in sorted(ids):
        name, p = compiled[k]
        # a pattern inside a key block, as its first line, is part of the block, which goes as a whole
        out += [("regex", name, None, m[0], m.start(), m.end()) for m in p.finditer(text) if not inside(m.start())]
    if "=" in text or ":" in text:
        for p in (_ENV, _CODE) if "=" in text else (_CODE,):
            pairs = [(m["key"], *m.span("inner" if p is _CODE or m["q"] else "bare")) for m in p.finditer(text)]
            for (key, s, e), trace in zip(pairs, _trace_lines(text, [x[1] for x in pairs])):
                if 8 <= e - s <= 500 and not trace:
                    out.append(("kv", None, key, text[s:e], s, e))
    for m in tokens:
        if not inside(m.start()):
            bare = m[0].lstrip(_EDGE_LEFT).rstrip(_EDGE_RIGHT)
            if 16 <= len(bare) <= 512:
                out.append(("opaque", None, None, bare, m.start(), m.end()))
    return out


def with_candidates(df: DataFrame, text: str, new: str = "__s_found", zoned: str | None = None) -> DataFrame:
    """``df`` and the array of candidates of its text column; after its zones, if they have a name, in the same pass."""
    from pyspark.sql.types import StructType

    from . import zones as Z

    at = df.columns.index(text)
    schema = StructType([*df.schema.fields, *StructType.fromDDL((f"{zoned} {Z.BLOCK}, " if zoned else "") + f"{new} {CANDIDATE}").fields])
    names = ("kind", "name", "key", "value", "start", "end")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            more = [pa.array([None if t is None else Z.zones(t) for t in texts], Z._ARROW)] if zoned else []
            got = [None if t is None else [dict(zip(names, c)) for c in candidates(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, *more, pa.array(got, _ARROW)], names=schema.names)

    return df.mapInArrow(run, schema)


@cache
def _confidences() -> str:
    return "CASE x_.name " + " ".join(f"WHEN '{p.name}' THEN {p.confidence}D" for p in content_patterns() if p.category == "Credential") + " END"


def _findings(found: str, least: float) -> str:
    q = SPARK
    v = "x_.value"
    measured = q.map(found, "x_", f"""named_struct('kind', x_.kind, 'name', x_.name, 'key', x_.key, 'value', {v}, 'start', x_.start, 'end', x_.end, 'rel_', {T.relative_entropy(q, v)}, 'div_', {T.diversity(q, v)}, 'even_', {T.evenness(q, v)}, 'obvious_', {T.obviously_not_secret(q, v)},
'fake_', x_.kind <> 'pem' AND ({T.placeholder(q, v)} OR {q.any_in(f'lower(trim({v}))', stopwords())}), 'best_', CASE WHEN x_.kind = 'kv' AND NOT {T.anti_indicated(q, 'x_.key', v)} AND NOT {T.compound_key(q, 'x_.key')} THEN {T.key_score(q, 'x_.key')} END)""")
    valid = "CASE x_.name " + " ".join(f"WHEN '{p.name}' THEN {validators.VALIDATORS[p.validator](q, v)}" for p in content_patterns() if p.category == "Credential" and p.validator in validators.VALIDATORS) + " ELSE true END"
    score, tier = "CAST(split(x_.best_, '[|]')[0] AS DOUBLE)", "split(x_.best_, '[|]')[1]"
    dotted = lambda e: re.sub(r"\b(rel_|div_|even_|obvious_)\b", r"x_.\1", e)
    conf = f"""CASE WHEN x_.kind = 'pem' THEN 0.95D WHEN x_.fake_ THEN 0D WHEN x_.kind = 'regex' THEN CASE WHEN NOT x_.obvious_ AND {valid} THEN {_confidences()} ELSE 0D END
WHEN x_.kind = 'kv' THEN CASE WHEN {score} > 0 THEN round({dotted(T.tiered_score(score, tier))}, 4) ELSE 0D END ELSE {dotted(T.opaque_confidence(q, v))} END"""
    label = "CASE x_.kind WHEN 'pem' THEN 'PRIVATE_KEY' WHEN 'regex' THEN CASE WHEN x_.name = 'private_key_pem' THEN 'PRIVATE_KEY' ELSE 'API_KEY' END WHEN 'kv' THEN split(x_.best_, '[|]')[2] ELSE 'OPAQUE_SECRET' END"
    detection = "CASE x_.kind WHEN 'pem' THEN 'pem_block' WHEN 'regex' THEN x_.name WHEN 'opaque' THEN 'opaque_token' ELSE '' END"
    evidence = f"CASE x_.kind WHEN 'pem' THEN concat('key block: ', x_.name) WHEN 'regex' THEN concat('pattern: ', x_.name) WHEN 'kv' THEN concat('key \"', x_.key, '\" tier ', {tier}) ELSE concat('token of ', length({v}), ' characters') END"
    scored = f"transform({measured}, (x_, i_) -> named_struct('entity_type', {label}, 'detection_type', {detection}, 'engine', CASE x_.kind WHEN 'regex' THEN 'regex' ELSE 'secret_scanner' END, 'confidence', {conf}, 'start', x_.start, 'end', x_.end, 'value_masked', {T.mask_text(q, v)}, 'evidence', {evidence}, 'seq_', i_))"
    return f"filter({scored}, x_ -> x_.confidence >= {least})"


def suppressed(spans: str) -> str:
    """Of overlapping spans the most confident, the first of equal ones; by start."""
    ordered = f"array_sort({spans}, (l, r) -> CASE WHEN l.confidence > r.confidence THEN -1 WHEN l.confidence < r.confidence THEN 1 WHEN l.seq_ < r.seq_ THEN -1 WHEN l.seq_ > r.seq_ THEN 1 ELSE 0 END)"
    kept = f"aggregate({ordered}, slice({spans}, 1, 0), (k_, f_) -> CASE WHEN exists(k_, o_ -> f_.start < o_.end AND f_.end > o_.start) THEN k_ ELSE concat(k_, array(f_)) END)"
    return f"array_sort({kept}, (l, r) -> CASE WHEN l.start < r.start THEN -1 WHEN l.start > r.start THEN 1 ELSE 0 END)"


def scan_text(df: DataFrame, text: str = "text", min_confidence: float = 0.3, new: str = "findings", zoned: str | None = None) -> DataFrame:
    """``df`` with the array of findings of its text column."""
    found = with_candidates(df, text, zoned=zoned).withColumn("__s_scored", F.expr(_findings("__s_found", min_confidence)))
    return found.withColumn(new, F.expr(f"transform({suppressed('__s_scored')}, x_ -> named_struct('entity_type', x_.entity_type, 'detection_type', x_.detection_type, 'engine', x_.engine, 'confidence', x_.confidence, 'start', x_.start, 'end', x_.end, 'value_masked', x_.value_masked, 'evidence', x_.evidence))")).drop("__s_found", "__s_scored")


def redacted(text: str, findings: str, strategy: str = "type-label") -> Column:
    """The text with its findings replaced: type-label, asterisk, placeholder or none. Of overlapping findings
    the one that starts last is replaced."""
    if strategy == "none":
        return F.col(text)
    label = {"type-label": "concat('[REDACTED:', f_.entity_type, ']')", "asterisk": "repeat('*', f_.end - f_.start)", "placeholder": "'«secret»'"}.get(strategy)
    if label is None:
        return F.col(text)
    back = f"array_sort({findings}, (l, r) -> CASE WHEN l.start > r.start THEN -1 WHEN l.start < r.start THEN 1 ELSE 0 END)"
    done = f"aggregate({back}, named_struct('tail', '', 'at', length({text})), (s_, f_) -> CASE WHEN f_.end <= s_.at THEN named_struct('tail', concat({label}, substring({text}, f_.end + 1, s_.at - f_.end), s_.tail), 'at', f_.start) ELSE s_ END, s_ -> concat(substring({text}, 1, s_.at), s_.tail))"
    return F.expr(f"CASE WHEN size({findings}) > 0 THEN {done} ELSE {text} END")


#: (zone, context of the value, change); the first that fits counts.
ZONE_RULES = [("cli_shell", "expression", -0.25), ("cli_shell", "literal", 0.0), ("code", "expression", -0.2), ("code", "literal", 0.05), ("config", "any", 0.05), ("error_output", "any", -0.15), ("markup", "any", -0.1), ("natural_language", "any", -0.1), ("query", "any", -0.05)]
_LITERAL = [r"=\s*[\x22\x27]", r":\s*[\x22\x27]", r"\([\x22\x27]", r">[\x22\x27]"]
_EXPRESSION = [r"^[A-Za-z_]\w*([.][A-Za-z_]\w*)+$", r"^[$][\w{]", r"^[A-Za-z_]\w*[\[(]", "^[{]{2}.*[}]{2}$"]


def adjusted(df: DataFrame, text: str = "text", findings: str = "findings", zones: str = "zones", least: float = 0.3, most: float = 0.99) -> DataFrame:
    """Findings with their confidence moved by the zone of their line; those below ``least`` go."""
    q = SPARK
    line = f"(x_.start - length(replace(substring({text}, 1, x_.start), '\\n', '')))"
    content = f"element_at(split({text}, '\\n'), CAST({line} + 1 AS INT))"
    context = f"CASE WHEN {' OR '.join(q.like(content, p) for p in _LITERAL)} THEN 'literal' WHEN {' OR '.join(q.like(content, p) for p in _EXPRESSION)} THEN 'expression' ELSE 'unknown' END"
    noted = f"transform({findings}, x_ -> named_struct('f', x_, 'zone', coalesce(try_element_at(filter({zones}, z_ -> {line} >= z_.start_line AND {line} < z_.end_line), 1).zone_type, ''), 'context', {context}))"
    delta = "CASE " + " ".join(f"WHEN y_.zone = '{z}'" + ("" if c == "any" else f" AND y_.context = '{c}'") + f" THEN {d}D" for z, c, d in ZONE_RULES) + " ELSE 0D END"
    conf = f"CASE WHEN y_.zone = '' THEN y_.f.confidence ELSE greatest(0D, least({most}D, y_.f.confidence + {delta})) END"
    fields = "entity_type detection_type engine start end value_masked evidence".split()
    moved = f"transform({noted}, y_ -> named_struct({', '.join(f''''{f}', y_.f.{f}''' for f in fields)}, 'confidence', {conf}))"
    return df.withColumn(findings, F.expr(f"filter({moved}, x_ -> x_.confidence >= {least})"))


def detect(df: DataFrame, text: str = "text", secrets: bool = True, zones: bool = True, strategy: str = "type-label", min_confidence: float = 0.3) -> DataFrame:
    """Zones, findings moved by their zones, and the redacted text, as columns of ``df``."""
    from .zones import with_zones

    out = with_zones(df, text) if zones and not secrets else df
    if secrets:
        out = scan_text(out, text, min_confidence, zoned="zones" if zones else None)
        if zones:
            out = adjusted(out, text)
        out = out.withColumn("redacted", redacted(text, "findings", strategy))
    return out
