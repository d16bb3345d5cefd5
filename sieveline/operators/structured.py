"""Credentials in SQL statements, HTTP headers, command lines and connection strings, and key-value parsing."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import text as T
from ..functions.dialect import Dialect

_Q = r"[\x22\x27]"
_IN = r"([^\x22\x27]+)"
#: (source, entity type, confidence, pattern, group); sources are tried one by one, rules within one as stated.
RULES = [
    ("sql", "OPAQUE_SECRET", 0.9, rf"(?i)(?:ALTER|CREATE)\s+(?:LOGIN|ROLE|USER)\s+\S+\s+(?:IDENTIFIED\s+BY|WITH\s+PASSWORD)\s*=?\s*{_Q}{_IN}{_Q}", 1),
    ("sql", "OPAQUE_SECRET", 0.9, rf"(?i)GRANT\s+.+?IDENTIFIED\s+BY\s+{_Q}{_IN}{_Q}", 1),
    ("sql", "OPAQUE_SECRET", 0.9, rf"(?i)SET\s+PASSWORD\s+(?:FOR\s+\S+\s+)?=\s*(?:PASSWORD\s*\()?\s*{_Q}{_IN}{_Q}", 1),
    ("sql", "OPAQUE_SECRET", 0.9, "(?i)(?:mariadb|mssql|mysql|postgres|postgresql)://([^:]+):([^@]+)@", 2),
    ("http_header", "API_KEY", 0.9, r"(?i)Authorization\s*:\s*(?:Bearer)\s+(\S+)", 1),
    ("http_header", "OPAQUE_SECRET", 0.9, r"(?i)Authorization\s*:\s*(?:Basic)\s+([0-9A-Za-z/+=]+)", 1),
    ("http_header", "API_KEY", 0.9, r"(?i)Authorization\s*:\s*(?:Token)\s+(\S+)", 1),
    ("http_header", "API_KEY", 0.9, r"(?i)X-API-Key\s*:\s*(\S+)", 1),
    ("http_header", "OPAQUE_SECRET", 0.9, r"(?i)Cookie\s*:.*?session[-_]?(?:id|token)?\s*=\s*([^;\s]+)", 1),
    ("http_header", "API_KEY", 0.9, r"(?i)(?:Access-Token|Api-Key|Auth-Token|X-Access-Token|X-Auth-Token)\s*:\s*(\S+)", 1),
]
_FLAGS = r"--?(?:access[-_]token|api[-_]?key|auth[-_]token|client[-_]secret|pass|passwd|password|private[-_]key|secret(?:[-_]key)?|token)"
COMMAND = [rf"(?i){_FLAGS}(?:\s*=\s*|\s+){_Q}?([^\s\x22\x27=]+)", rf"(?i)\s-p\s+{_Q}?([^\s\x22\x27]+)"]
#: Tried in this order; the first that gives a viable credential counts.
CONNECTION = [
    (0.9, r"(?i)jdbc:[a-z]+://[^;?]*[;?].*?(?:password|pwd)\s*=\s*([^;&]+)", 1, False),
    (0.9, r"(?i)(?:DSN|Driver)\s*=.*?(?:Password|Pwd)\s*=\s*([^;]+)", 1, False),
    (0.9, r"(?i)redis://[^:@/]*:(.+)@[-.\w]+", 1, True),
    (0.9, r"(?i)(?:amqp|mariadb|mongodb(?:[+]srv)?|mssql|mysql|postgres|postgresql|rabbitmq)://([^:]+):(.+)@[-.\w]+", 2, True),
    (0.85, r"(?i)(?:^|;)\s*(?:password|pwd)\s*=\s*([^;]+)", 1, False),
]
_FAKE = r"(?i)<[^>]{1,80}>|[{]{2}.*?[}]{2}|[$][{][_A-Z]+[}]|x{5,}|[*]{3,}|your[-_ ]?(key|password|secret|token)|%b(changeme|example|placeholder|redacted)%b|%bpassword%b$"


def viable(q: Dialect, v: str) -> str:
    return f"(length({v}) >= 6 AND NOT {q.like(v, _FAKE)})"


def rule_sql(q: Dialect, source: str, key: str, text: str) -> str:
    """(key, source, entity_type, confidence, credential) of every rule that finds a viable credential."""
    parts = []
    for k, (src, entity, conf, p, g) in enumerate(RULES):
        parts.append(f"SELECT {key}, {k} AS rule, '{src}' AS source, '{entity}' AS entity_type, CAST({conf} AS DOUBLE) AS confidence, trim({q.first(text, p, g)}) AS credential FROM {source} WHERE {q.like(text, p)}")
    for p in COMMAND:
        parts.append(f"SELECT DISTINCT {key}, 20 AS rule, 'cli_argument' AS source, 'OPAQUE_SECRET' AS entity_type, CAST(0.85 AS DOUBLE) AS confidence, credential FROM (SELECT {key}, {q.explode(q.all(text, p, 1))} AS credential FROM {source} WHERE {q.contains(text, '-')}) c_")
    tests, creds = [], []
    for conf, p, g, coded in CONNECTION:
        c = f"trim({q.first(text, p, g)})"
        creds.append((T.url_decoded(q, c) if coded else c, conf))
        tests.append(f"{q.like(text, p)} AND {viable(q, creds[-1][0])}")
    pick = lambda i: "CASE " + " ".join(f"WHEN {t} THEN {x[i]}" for t, x in zip(tests, creds)) + " END"
    parts.append(f"SELECT {key}, 30 AS rule, 'connection_string' AS source, 'OPAQUE_SECRET' AS entity_type, CAST({pick(1)} AS DOUBLE) AS confidence, {pick(0)} AS credential FROM {source} WHERE {' OR '.join(tests)}")
    union = " UNION ALL ".join(parts)
    return f"SELECT {key}, rule, source, entity_type, confidence, credential FROM ({union}) u_ WHERE {viable(q, 'credential')}"


# -- key-value parsing --------------------------------------------------------------------------------
def flatten(value, at: str = "") -> list[tuple[str, str]]:
    """Dotted keys of nested values; items of a list that are no maps keep the key of the list."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in flatten(v, f"{at}.{k}" if at else str(k))]
    if isinstance(value, list):
        return [p for i, v in enumerate(value) for p in (flatten(v, f"{at}[{i}]") if isinstance(v, dict) else flatten(v, at))]
    return [] if value is None or not at else [(at, str(value).lower() if isinstance(value, bool) else str(value))]


def from_json(text: str) -> list[tuple[str, str]]:
    if text.lstrip()[:1] not in ("{", "["):
        return []
    try:
        return flatten(json.loads(text))
    except (ValueError, RecursionError):
        return []


def _scalar(v: str) -> str:
    v = v.strip()
    if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
        return v[1:-1]
    return re.split(r"\s#", v)[0].strip()


_LINE = re.compile(r"^(?P<pad>\s*)(?:-\s+)?(?P<key>[\w.-]+|\x22[^\x22]+\x22|'[^']+')\s*:(?:\s+(?P<value>.*))?$")


def from_yaml(text: str) -> list[tuple[str, str]]:
    """Block maps and lists of scalars; nothing if a line is neither."""
    out: list[tuple[str, str]] = []
    path: list[tuple[int, str]] = []
    for x in text.split("\n"):
        if not x.strip() or x.lstrip().startswith(("#", "---")):
            continue
        m = _LINE.match(x)
        if not m:
            item = re.match(r"^\s*-\s+(.*)$", x)
            if item and path:
                out.append((".".join(k for _, k in path), _scalar(item[1])))
                continue
            return []
        pad = len(m["pad"])
        while path and path[-1][0] >= pad:
            path.pop()
        path.append((pad, m["key"].strip("\"'")))
        if m["value"]:
            out.append((".".join(k for _, k in path), _scalar(m["value"])))
    return out


def from_toml(text: str) -> list[tuple[str, str]]:
    """Tables and assignments of scalars."""
    out, table = [], ""
    for x in text.split("\n"):
        x = x.strip()
        head = re.fullmatch(r"\[{1,2}([^\[\]]+)\]{1,2}", x)
        pair = re.match(r"^([\w.-]+)\s*=\s*(\S.*)$", x)
        if head:
            table = head[1].strip() + "."
        elif pair:
            out.append((table + pair[1], _scalar(pair[2])))
    return out


def from_url(text: str) -> list[tuple[str, str]]:
    """Parameters of the URLs in a text."""
    return [(unquote(k), unquote(v.replace("+", " "))) for u in re.findall(r"[?]([^\s\x22'<>#]+)", text) for k, s, v in (p.partition("=") for p in u.split("&")) if s and v]


def from_connection(text: str) -> list[tuple[str, str]]:
    """Fields of ``a=b;c=d`` strings, and user and password of URIs."""
    out = [(k.strip(), v.strip()) for k, s, v in (p.partition("=") for p in text.split(";")) if s and v.strip() and re.fullmatch(r"[\w ]+", k.strip())] if ";" in text else []
    for m in re.finditer(r"\w+://([^\s:/@]*):([^\s@]+)@", text):
        out += [("user", unquote(m[1]))] * bool(m[1]) + [("password", unquote(m[2]))]
    return out


def key_values(text: str | None) -> list[tuple[str, str]]:
    """Pairs of a text: of JSON, else YAML, else assignments, connection strings and URLs; the first of equal ones."""
    from .spans import _CODE, _ENV

    if not text or not text.strip():
        return []
    found = from_json(text) or (from_yaml(text) if ":" in text and "=" not in text else [])
    if not found:
        found = [(m["key"], m["inner"] if m["q"] else m["bare"]) for p in (_ENV, _CODE) for m in p.finditer(text)]
        found += from_toml(text) if re.search(r"(?m)^\[[^\]]+\]\s*$", text) else []
        found += from_connection(text) + (from_url(text) if "://" in text else [])
    return list(dict.fromkeys((k, v) for k, v in found if v))


def with_key_values(df: DataFrame, text: str = "text", new: str = "pairs") -> DataFrame:
    """``df`` and the array of (key, value) of its text column; null texts have none."""
    from pyspark.sql.types import StructType

    at = df.columns.index(text)
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"{new} array<struct<key:string,value:string>>").fields])
    kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))

    def run(batches):
        for b in batches:
            got = [[{"key": k, "value": v} for k, v in key_values(t)] for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=schema.names)

    return df.mapInArrow(run, schema)
