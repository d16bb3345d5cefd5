"""Zones: a text cut into typed runs of lines.

code, markup, config, query, cli_shell, data, error_output and natural_language. A built-in expression
tells plain prose (most texts) from the rest, a function of one text does the segmentation: its steps
carry state from line to line (fences, brackets, indentation), which no window expresses. Rows are
independent: no shuffle, and the same plan on streams.

Every non-blank line is in exactly one block. A null or blank text has no blocks.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import Dialect

BLOCK = "array<struct<start_line:int,end_line:int,zone_type:string,confidence:double,method:string,language_hint:string,language_confidence:double>>"
_ARROW = pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("zone_type", pa.string()), ("confidence", pa.float64()), ("method", pa.string()), ("language_hint", pa.string()), ("language_confidence", pa.float64())]))

_TAGS = {
    "code": "python py=python javascript js=javascript typescript ts=typescript java c cpp c++=cpp csharp cs=csharp go golang=go rust rs=rust ruby rb=ruby php swift kotlin scala r lua perl dart haskell hs=haskell elixir clojure jsx tsx vue svelte matlab julia objective-c objc=objective-c groovy powershell ps1=powershell vb vba asm=assembly assembly nasm=assembly css scss sass less",
    "query": "sql graphql gql=graphql cypher",
    "markup": "html xml svg",
    "config": "json yaml yml=yaml toml ini env dotenv=env properties hcl tf=hcl",
    "data": "csv tsv",
    "cli_shell": "bash sh shell=sh zsh fish bat cmd console=sh terminal=sh",
    "natural_language": "text= txt= plaintext= markdown= md=",
}
TAGS = {t.partition("=")[0]: (zone, t.partition("=")[2] if "=" in t else t) for zone, ts in _TAGS.items() for t in ts.split()}

_SYNTAX = frozenset("{}()[];=<>|&!@#$^*/\\~")
_STRICT = re.compile(r"\b(?:System|async|await|boolean|chan|console|const|def|defer|elif|enum|extern|fallthrough|fmt|fn|goto|impl|lambda|mut|namespace|printf|println|pub|register|sizeof|std|struct|typedef|val|var|void|volatile|yield)\b")
_CONTEXTUAL = re.compile(r"\b(?:abstract|assert|bool|break|case|catch|char|class|continue|default|do|double|else|except|export|extends|finally|float|for|from|function|go|if|implements|import|include|int|interface|let|local|long|match|module|new|override|package|private|protected|public|raise|require|return|select|self|static|string|super|switch|this|throws?|trait|try|type|unsafe|use|using|virtual|while)\b")
_KEYWORDS = frozenset((_STRICT.pattern + _CONTEXTUAL.pattern).replace(r"\b(?:", " ").replace(r")\b", " ").replace("|", " ").replace("throws?", "throw throws").split())
_FAMILIES = [
    ("c_family", [r"^\s*(?:break|case|continue|else|for|if|return|switch|while)\s*[({]", r"^\s*(?:auto|bool|boolean|char|const|double|float|int|let|long|string|var|void)\s+\w+", r"^\s*(?:class|enum|func|function|interface|private|protected|public|static|struct)\s", r"^\s*\w+[.]\w+\(.*\)", r"^\s*\w+\s*:?=\s*\S", r"[;{}]\s*$", r"^\s*(?:catch|finally|throws?|try)\s*[({]", r"^\s*(?:import|namespace|package|using)\s+[.\w]+", r"^\s*(?:chan|defer|go|select)\s", r"^\s*#(?:define|endif|ifn?def|include|pragma)\s"]),
    ("python", [r"^\s*(?:assert|class|def|del|from|global|import|nonlocal|pass|raise|return|yield)\s", r"^\s*(?:case|elif|else|except|finally|for|if|match|try|while|with)\b.*:\s*(?:#.*)?$", r"^\s*@\w+", r"^\s*(?:getattr|hasattr|input|isinstance|len|open|print|range|setattr|super|type)\s*\(", r"^\s*(?:cls|self)[.]\w+"]),
    ("markup", [r"<\w+[>\s]", r"</\w+>", r"^\s*\w[-\w]*\s*:\s*.+;", r"^\s*[#.@]\w+.*[{]", r"^\s*<(?:!DOCTYPE|\?xml)\s"]),
    ("sql", [r"^\s*(?:ALTER|CREATE|DELETE|DROP|INSERT|MERGE|SELECT|TRUNCATE|UPDATE)\s", r"^\s*(?:AND|CROSS|EXISTS|FROM|IN|INNER|JOIN|LEFT|NOT|ON|OR|OUTER|RIGHT|WHERE)\s", r"^\s*(?:GROUP\s+BY|ORDER\s+BY|EXCEPT|HAVING|INTERSECT|LIMIT|OFFSET|UNION)\s", r"^\s*(?:ANALYZE|BEGIN|CALL|COMMIT|DECLARE|EXEC|EXECUTE|EXPLAIN|GRANT|REVOKE|ROLLBACK|SET)\s"]),
    ("shell", [r"^\s*[$]\s+\w", r"^\s*(?:chmod|chown|cp|ln|mkdir|mv|rm|rmdir|sudo|touch)\s", r"^\s*(?:apt|brew|curl|dnf|docker|git|kubectl|npm|pacman|pip|wget|yum)\s", r"^\s*(?:alias|echo|eval|exec|export|printf|read|source|unalias)\s", r"^\s*(?:at|crontab|journalctl|nohup|service|systemctl)\s", r"^\s*(?:lsof|nc|netstat|rsync|scp|sftp|ss|ssh|telnet)\s", r"[|]\s*(?:awk|cut|grep|head|sed|sort|tail|tr|wc|xargs)\s"]),
    ("assembly", [r"(?i)^\s*(?:add|call|cmp|div|idiv|imul|int|jmp|jn?[ez]|j[gl]e|lea|mov|mul|nop|pop|push|ret|sh[lr]|sub|test|xor)\s", r"(?i)\b[er][abcd]x\b|\b[er][sd]i\b|\b[er][sb]p\b", r"(?i)^\s*section\s+[.]"]),
    ("rust", [r"^\s*(?:crate|extern|fn|impl|mod|trait|use|let\s+mut|pub\s+(?:enum|fn|struct))\s", r"\b(?:unwrap\(\)|expect\(\x22)", r"::\w+", r"->\s*\w+", r"^\s*#\[\w+", r"\b(?:Arc|Box|Option|Rc|Result|Vec)<"]),
]
_FAMILIES = [(n, re.compile("|".join(f"(?:{p.replace('(?i)', '')})" for p in ps), re.I if n == "assembly" else 0)) for n, ps in _FAMILIES]
_C_MARKS = {
    "c": [r"\bprintf\s*\(", r"#include\s*<std(?:io|lib)", r"\b(?:free|malloc)\s*\("], "cpp": [r"\bcout\s*<<", r"\bstd::", r"\btemplate\s*<", r"\bvector<"], "csharp": [r"\bConsole[.]Write", r"\busing\s+System", r"\basync\s+Task"], "go": [r"\bfmt[.]", r"\bfunc\s+\w+\(", ":=", r"\bpackage\s+main", r"\bdefer\s"],
    "java": [r"\bSystem[.]out[.]", r"\bpublic\s+static\s+void\s+main", r"\bpackage\s+\w+[.]\w+", "@Override"], "javascript": [r"\b(?:console|document|window)[.]\w+", r"\brequire\s*\(", r"\bmodule[.]exports", "=>"], "typescript": [r":\s*(?:any|boolean|number|string)\b", r"\binterface\s+\w+\s*[{]", r"\bas\s+\w+"],
}
_C_MARKS = {k: [re.compile(p) for p in v] for k, v in _C_MARKS.items()}
_INTRO = re.compile(r"(?:as follows|code|command|example|here is|output|result|run this|script|see below|shown below|snippet).*:?\s*$")
_COMMENT = re.compile(r"^\s*(?:#(?!define|endif|ifn?def|include|pragma)|//|--|/[*]|[*](?!/)|%|REM\s)")
_ASSIGN = re.compile(r"^\s*[A-Za-z_]\w*\s*[:=]")
_CALL = re.compile(r"\b[A-Za-z_]\w*+\(")
_DOTTED = re.compile(r"(?<!\w)\d*+[A-Za-z_]\w*+[.][A-Za-z_]")
_TOKENS = re.compile(r"(?P<s>\x22[^\x22]*\x22|'[^']*')|(?P<n>\b\d[\d.]*)|(?P<i>[A-Za-z_]\w*)|(?P<o>[-+*/%<>=!&|^]+)|(?P<d>[.])")
_ERROR = re.compile(
    "|".join(
        [r"^\s*Traceback \(most recent", r"^\s*File \x22.+\x22, line \d+", r"^\s*at \w[.\w]+\([^)]*[.](?:cs|java|js|kt|py|scala|ts):\d+\)", r"^\s*at \w[.\w]+(?:\s\(.+:\d+:\d+\)|[.]<)", r"^\w+(?:Error|Exception|Warning):\s", r"^\s*(?:error|warning)\[?\w*\]?\s*:", r"^\s*-->\s+\S+:\d+:\d+", r"^\s*(?:\^+|~{3,}|[|])\s*$", r"^\s*(?:npm ERR!|pip ERR)",
         r"^\s*Requirement already satisfied:", r"^\s*\[?(?:CRITICAL|DEBUG|ERROR|FATAL|INFO|WARN)\]?\s", r"^\[?\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d|\])", r"panic:\s", r"goroutine \d+ \[", r"^\s*(?:\w+[.]rb:\d+|from\s+\S+:\d+):in\s"]
    )
)
_MATH = re.compile(r"\\(?:alpha|begin|beta|end|frac|int|sum|theta)|[∩∪≤≥⊂⊆∈∉→←↔∀∃∅]|(?<![.])\b(?:cos|deg|det|dim|exp|inf|ker|lim|ln|log|sin|sqrt|sup|tan)\b|\b(?:corollary|hypothesis|lemma|proof|proposition|theorem)\b|(?:Prob|Cov|Var|[EP])\[")
_PROSE = re.compile(r"^[A-Z][a-z].+[.!?]$")
_DIALOG = re.compile(r"^\s*[A-Z][a-z]{1,20}:\s*[\x22A-Z]|^\s*\([A-Z][a-z]{1,20}\)\s|^\s*\[[A-Z][a-z]{1,20}\]\s")
_RATIO = re.compile(r"^\s*\d+:\d+\s")
_LIST = re.compile(r"^\s*(?:\d+[.):]\s+|[-•*]\s+|[a-z][.)]\s+)")
_CONSTRUCTS = [re.compile(p, re.M) for p in (r"^[^\S\n]*+(?:def|fn|func|function|sub)\s+\w+\s*\(", r"^[^\S\n]*+\w++(?:[.]\w++)*+\s*+(?::?\s*+\w++\s*+)?=(?!=)\s*+\S", r"^[^\S\n]*+(?:#include|from|import|package|require|using)\s+[\"'./<{\w]", r"^[^\S\n]*+(?:class|enum|interface|struct|trait)\s+\w+\s*[({:<]", r"^[^\S\n]*+(?:elif|else\s*if|for|if|match|switch|while)\s*[({]", r"\b[A-Za-z_]\w*+[.][A-Za-z_]\w*+\s*+\(", r"^[^\S\n]*+@[A-Za-z_]", r"^[^\S\n]*+#(?:define|endif|ifn?def|import|pragma)\s", r"^[^\S\n]*+(?:raise|return|throw|yield)\s+\S", r"^[^\S\n]*+\S.*;[^\S\n]*$", r"(?<!\\)\b[A-Za-z_]\w*+\(", r"(?i)^[^\S\n]*+(?:alter\s+table|create\s+table|delete\s+from|drop\s+table|insert\s+into|select\s.+\sfrom\s|update\s+\w+\s+set)", r"^[^\S\n]*+[A-Za-z_][.\w]*\s*<-\s*\S")]
_NOTATION = re.compile(r"\\(?:cdot|frac|int|left|mathbb|nabla|partial|right|sqrt|sum|text)\b|[∑∏∫∂∇λΔΣΩπμθ≈≠≤≥±∈∉⊂⊃∪∩∞]")
_KV = re.compile(r"^\s*[-\w.\x22' ]+:(?:\s|$)")
_ITEM = re.compile(r"^\s*-\s+\S")
_ENV = re.compile(r"^(?:export\s+)?[A-Z_][A-Z0-9_]*=\S*")
_OPEN, _CLOSE = re.compile(r"<([A-Za-z][-:\w]*)(?:\s[^<>]*)?/?>"), re.compile(r"</([A-Za-z][-:\w]*)\s*>")
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})\s*([-+#.\w]*)\s*$")


def prescreen_sql(q: Dialect, v: str) -> str:
    """Whether a text may hold anything but prose and data."""
    marks = q.replace(v, r"[^{}()\[\];=<>|&@#$^~]")
    tests = [q.like(v, "`{3}|~{3}|</"), q.like(v, r"\n(    |\t)"), f"length({marks}) > 0.03 * length({v})"]
    return "(" + " OR ".join(tests) + ")"


def prescreen(text: str) -> bool:
    return "```" in text or "~~~" in text or "</" in text or "\n    " in text or "\n\t" in text or sum(map(text.count, "{}()[];=<>|&@#$^~")) > 0.03 * len(text)


def letters(line: str) -> float:
    s = line.strip()
    return (len(s) - len(_NO_LETTER.findall(s))) / max(1, len(s))


def keyword_hits(line: str) -> int:
    n = len(_STRICT.findall(line))
    first = len(line) - len(line.lstrip())
    for m in _CONTEXTUAL.finditer(line):
        at, after = m.start(), line[m.end() : m.end() + 20]
        if at <= first or line[at - 1] == "." or any(c in "([{:=" for c in after):
            n += 1
    return n


def line_score(line: str) -> float:
    """How much a line looks like code, from 0 to 1."""
    s = line.strip()
    if not s:
        return 0.0
    dense = len(_MARK.findall(s)) / len(s)
    score = 0.3 if dense > 0.15 else 0.15 if dense > 0.08 else 0.0
    words = keyword_hits(s)
    score += 0.3 if words >= 2 else 0.15 if words else 0.0
    score += (0.1 if s[-1] in "{;)],:" else 0.0) + (0.1 if _ASSIGN.match(s) else 0.0) + (0.05 if len(line) - len(line.lstrip()) >= 2 else 0.0)
    kinds: Counter = Counter()
    quoted = 0
    dots = _DOTTED.search(s)
    for m in _TOKENS.finditer(s):
        kinds[m.lastgroup] += 1
        quoted += len(m[0]) if m.lastgroup == "s" else 0
    names, ops = kinds["i"], kinds["o"]
    if dots and names:
        score *= 1.3
    elif names and ops:
        score *= 1.2
    elif (names >= 4 and words <= 1) or (quoted / len(s) > 0.4 and not words) or (not names and not words and kinds):
        score = 0.0
    if names and _CALL.search(s):
        score += 0.1
    elif not names and not words and kinds["n"] + kinds["s"]:
        score -= 0.1
    return min(1.0, max(0.0, score))


def family_of(line: str) -> str | None:
    return next((n for n, p in _FAMILIES if p.search(line)), None)


def smoothed(lines: list[str], claimed: list[bool]) -> list[float]:
    """Line scores blended with their neighbours; -1 where claimed."""
    raw = [-1.0 if c else min(1.0, line_score(x) + (0.25 if x.strip() and family_of(x) else 0.0)) for x, c in zip(lines, claimed)]
    out = list(raw)
    for i, r in enumerate(raw):
        if r < 0:
            continue
        near = [raw[j] for j in (i - 1, i + 1) if 0 <= j < len(raw) and raw[j] >= 0]
        mean = sum(near) / len(near) if near else 0.0
        lift = 0.0
        if i and raw[i - 1] >= 0:
            if lines[i - 1].rstrip().endswith((":", "{")) and raw[i - 1] > 0.2:
                lift = 0.1
            if _INTRO.search(lines[i - 1]):
                lift = 0.15
        bridge = 0.8 * mean if r == 0 and mean > 0.3 and _COMMENT.match(lines[i]) else 0.0
        out[i] = 0.7 * r + 0.2 * mean + lift + bridge if lines[i].strip() else 0.0
    # comment blocks between two pieces of code
    i = 0
    while i < len(out):
        j = i
        while j < len(out) and out[j] >= 0 and _COMMENT.match(lines[j]):
            j += 1
        if j > i:
            around = [out[k] for k in (i - 1, j) if 0 <= k < len(out)]
            if len(around) == 2 and min(around) > 0.3 and j - i <= 4:
                for k in range(i, j):
                    out[k] = max(out[k], 0.8 * min(around))
        i = max(j, i + 1)
    return out


def scoped(lines: list[str], scores: list[float]) -> list[float]:
    """Lines inside open brackets, or indented under a header, inherit from it."""
    out = list(scores)
    depth, parent = 0, 0.0
    for i, x in enumerate(lines):
        if out[i] < 0:
            depth, parent = 0, 0.0
            continue
        if depth and out[i] == 0 and parent >= 0.3 and x.strip():
            out[i] = 0.9 * parent
        depth = max(0, depth + sum(c in "([{" for c in x) - sum(c in ")]}" for c in x))
        parent = out[i] if out[i] >= 0.3 else parent
    level, head = -1, 0.0
    for i, x in enumerate(lines):
        s = x.strip()
        if out[i] < 0:
            level, head = -1, 0.0
        elif s:
            indent = len(x) - len(x.lstrip())
            if level >= 0 and indent <= level:
                level, head = -1, 0.0
            if level >= 0 and out[i] == 0 and head >= 0.3:
                out[i] = 0.5 * head
            if out[i] >= 0.3 and s.endswith((":", "{")):
                level, head = indent, out[i]
    return out


def negative(line: str) -> str | None:
    """``suppress``, ``error`` or nothing."""
    if _MATH.search(line):
        return "suppress"
    if _ERROR.search(line):
        return "error"
    share = letters(line)
    if (_PROSE.match(line) and share > 0.75) or (_DIALOG.match(line) and share > 0.7) or _RATIO.match(line):
        return "suppress"
    return None


_NO_LETTER, _MARK, _NUMBER = re.compile(r"[^\w\s]|[\d_]"), re.compile("[" + re.escape("".join(sorted(_SYNTAX))) + "]"), re.compile(r"\d(?:(?<!\S\d)|(?<=[-+$€]\d)(?<!\S[-+$€]\d))[\d.,:%/-]*(?!\S)")  # begins with its digit, so that what has none is skipped


_GONE = {c: None for c in range(128) if _NO_LETTER.match(chr(c))}


def _letters(text: str) -> int:
    """How many characters ``_NO_LETTER`` leaves."""
    return len(text.translate(_GONE)) if text.isascii() else len(text) - len(_NO_LETTER.findall(text))


def _sentence(line: str) -> bool:
    s = line.strip().rstrip("\"')")
    return s[-1:] in (".", "!", "?") and s[0].isalpha() and s.count(" ") >= 2


def features(lines: list[str]) -> dict[str, float]:
    """Measures of a block, for the data and prose detectors."""
    solid = [x for x in lines if x.strip()]
    text = "\n".join(lines)
    chars = max(1, len(text) - len(lines) + 1)
    words = text.lower().split()
    n = max(1, len(solid))
    parted = [c for c in ",;\t|" if c in text]
    counts = [max(map(x.count, parted), default=0) for x in solid]
    common = Counter(counts).most_common(1)[0] if counts else (0, 0)
    heads = Counter(re.sub(r"\d+", "0", x.split()[0])[:8] for x in solid)
    size = [len(x) for x in solid]
    mean = sum(size) / n
    spread = (sum((s - mean) ** 2 for s in size) / n) ** 0.5 / mean if mean else 0.0
    return {
        "alpha": (chars - len(text) + _letters(text)) / chars,
        "syntax": sum(map(text.count, _SYNTAX)) / chars,
        "sentence": sum(map(_sentence, solid)) / n,
        "keywords": sum(map(_KEYWORDS.__contains__, words)) / max(1, len(words)),
        "numeric": len(_NUMBER.findall(text)) / max(1, len(words)),
        "delimiter": sum(c >= 2 for c in counts) / n,
        "uniform": max(0.0, 1.0 - spread) if not common[0] else max(common[1] / n, max(0.0, 1.0 - spread)),
        "prefix": max(heads.values()) / n >= 0.5 if len(solid) >= 3 else False,
        "lines": len(lines),
    }


def _data(lines: list[str]) -> tuple[str, float] | None:
    solid = [x for x in lines if x.strip()]
    if len(lines) < 3 or not solid:
        return None
    f = features(lines)
    pipes = sum(x.count("|") >= 2 for x in solid) / len(solid)
    tabs = sum("\t" in x for x in solid) / len(solid)
    if pipes >= 0.7:
        return "table", min(0.95, 0.6 + 0.3 * pipes)
    if f["delimiter"] > 0.6 and f["uniform"] > 0.5 and f["sentence"] < 0.3:
        return "csv", min(0.95, 0.55 + 0.2 * f["delimiter"] + 0.15 * f["uniform"])
    if tabs >= 0.7 and f["uniform"] > 0.4:
        return "csv", min(0.95, 0.6 + 0.25 * f["uniform"])
    if f["prefix"] and f["uniform"] > 0.5 and f["sentence"] < 0.4:
        return "log", min(0.9, 0.55 + 0.25 * f["uniform"])
    if f["uniform"] > 0.6 and f["numeric"] > 0.15 and f["sentence"] < 0.2:
        return "structured", min(0.9, 0.5 + 0.2 * f["uniform"] + 0.2 * f["numeric"])
    return None


def _prose(lines: list[str]) -> float:
    f = features(lines)
    size = 0.2 if f["lines"] <= 1 else 0.4 if f["lines"] <= 3 else 0.7 if f["lines"] <= 7 else 1.0
    raw = 0.25 * f["alpha"] + 0.25 * f["sentence"] + 0.2 * (1 - f["keywords"]) + 0.15 * max(0.0, 1 - 10 * f["syntax"]) + 0.15 * size
    return min(0.95, max(0.2, 0.6 * raw if f["lines"] <= 3 and f["sentence"] < 0.1 else raw))


def regions(lines: list[str], claimed: list[bool], gap: int | None) -> list[tuple[int, int]]:
    """Runs of unclaimed lines that start and end with text and hold at most ``gap`` blank lines in a row."""
    out, start, last, blank = [], None, 0, 0
    for i, x in enumerate(lines):
        if claimed[i]:
            if start is not None:
                out.append((start, last + 1))
            start = None
        elif x.strip():
            if start is not None and gap is not None and blank > gap:
                out.append((start, last + 1))
                start = None
            start = i if start is None else start
            last, blank = i, 0
        else:
            blank += 1
    if start is not None:
        out.append((start, last + 1))
    return out


def _format(lines: list[str]) -> tuple[str, str, float] | None:
    text = "\n".join(lines).strip()
    solid = [x for x in lines if x.strip()]
    if (text[:1], text[-1:]) in (("{", "}"), ("[", "]")):
        try:
            json.loads(text)
            return "config", "json", 0.9
        except ValueError:
            pass
    if len(solid) < 5 and not (len(solid) >= 2 and all(_ENV.match(x.strip()) for x in solid)):
        return None
    opened, closed = _OPEN.findall(text), _CLOSE.findall(text)
    plain = sum(letters(x) > 0.85 for x in solid) / len(solid)
    if len(opened) >= 2 and closed and {x.lower() for x in opened} & {x.lower() for x in closed} and plain <= 0.7 and sum(x.lstrip().startswith("<") for x in solid) / len(solid) >= 0.3:
        return "markup", "xml", 0.8
    keys = [x for x in solid if _KV.match(x)]
    long = sum(len(x.split(":")[0].split()) > 3 for x in keys)
    if len(keys) >= 3 and plain <= 0.5 and long <= 0.5 * len(keys) and (len(keys) + sum(bool(_ITEM.match(x)) for x in solid)) / len(solid) > 0.5:
        return "config", "yaml", 0.8
    env = sum(bool(_ENV.match(x.strip())) for x in solid)
    if env >= 2 and env / len(solid) > 0.5:
        return "config", "env", 0.85
    return None


def _language(lines: list[str]) -> tuple[str, float]:
    hits = Counter(f for f in map(family_of, lines) if f)
    if not hits:
        return "", 0.0
    best, n = sorted(hits.items(), key=lambda x: (-x[1], x[0]))[0]
    share = n / sum(hits.values())
    if best == "c_family":
        text = "\n".join(lines)
        marks = {k: sum(bool(p.search(text)) for p in ps) for k, ps in _C_MARKS.items()}
        top = max(sorted(marks), key=lambda k: marks[k])
        best = top if marks[top] else "c_family"
    return best, share


def _zone_of(language: str) -> str:
    return {"sql": "query", "shell": "cli_shell", "markup": "markup"}.get(language, "code")


def _fenced(lines: list[str], claimed: list[bool]) -> list[dict]:
    out = []
    i, n = 0, len(lines)
    while i < n:
        m = _FENCE.match(lines[i])
        tag = re.match(r"^\s*<(script|style)\b", lines[i], re.I)
        if m:
            j = next((k for k in range(i + 1, n) if (c := _FENCE.match(lines[k])) and c[1][0] == m[1][0] and len(c[1]) >= len(m[1]) and not c[2]), n - 1)
            body = lines[i + 1 : j]
            zone, lang = TAGS.get(m[2].lower(), (None, m[2].lower()))
            if zone is None:
                f = features(body) if any(x.strip() for x in body) else None
                zone = "natural_language" if not m[2] and f and f["sentence"] > 0.5 and f["alpha"] > 0.8 else "code"
                lang = _language(body)[0] if not m[2] and zone == "code" else lang
            out.append(_block(i, j + 1, zone, 0.95, "structural_fence", lang, 0.95 if lang else 0.0))
        elif tag:
            j = next((k for k in range(i, n) if f"</{tag[1].lower()}>" in lines[k].lower()), n - 1)
            out.append(_block(i, j + 1, "code", 0.9, "structural_delimiter", "javascript" if tag[1].lower() == "script" else "css", 0.9))
        else:
            i += 1
            continue
        claimed[i : j + 1] = [True] * (j + 1 - i)
        i = j + 1
    return out


def _block(a: int, b: int, zone: str, conf: float, method: str, lang: str = "", lang_conf: float = 0.0) -> dict:
    return {"start_line": a, "end_line": b, "zone_type": zone, "confidence": round(conf, 4), "method": method, "language_hint": lang, "language_confidence": round(lang_conf, 4)}


def _runs(lines: list[str], scores: list[float], errors: list[bool], claimed: list[bool]) -> list[tuple[int, int, bool]]:
    """(start, end, error) of runs of scored lines; three lines of nothing end one, up to four are bridged."""
    out: list[list] = []
    start, last, kind, idle = None, 0, False, 0
    for i, x in enumerate(lines):
        active = errors[i] or scores[i] > 0
        if claimed[i] or (start is not None and active and errors[i] != kind):
            if start is not None:
                out.append([start, last + 1, kind])
            start, idle = None, 0
            if claimed[i]:
                continue
        if active:
            start = i if start is None else start
            kind, last, idle = errors[i], i, 0
        elif x.strip():
            idle += 1
            if idle >= 3 and start is not None:
                out.append([start, last + 1, kind])
                start = None
    if start is not None:
        out.append([start, last + 1, kind])
    joined: list[list] = []
    for r in out:
        if joined and joined[-1][2] == r[2] and r[0] - joined[-1][1] <= 4 and not any(claimed[joined[-1][1] : r[0]]):
            joined[-1][1] = r[1]
        else:
            joined.append(r)
    return [tuple(r) for r in joined]


def _assembled(lines: list[str], scores: list[float], errors: list[bool], claimed: list[bool]) -> list[dict]:
    out = []
    for a, b, error in _runs(lines, scores, errors, claimed):
        body, own = lines[a:b], [s for s in scores[a:b] if s > 0]
        mean = sum(own) / len(own) if own else 0.0
        text = "\n".join(body)
        constructs = 0 if error else sum(min(len(p.findall(text)), 3) > 0 for p in _CONSTRUCTS)
        if b - a < 8 and (b - a < 3 or (mean < 0.4 and constructs < 2 and not error)):
            continue
        heads = Counter(" ".join(x.split()[:2]) for x in body if x.strip())
        solid = sum(heads.values())
        repetitive = solid >= 3 and max(heads.values()) / solid >= 0.5
        high = sum(s >= 0.4 for s in scores[a:b]) / (b - a)
        blank = 1 - solid / (b - a)
        if error or repetitive:
            share = sum(errors[a:b]) / (b - a)
            out.append(_block(a, b, "error_output", min(0.95, max(0.5, 0.5 + 0.4 * share - 0.1 * blank)), "syntax_score"))
            continue
        if (b - a >= 20 and high < 0.2) or not constructs or (_NOTATION.search(text) and constructs <= 2):
            continue
        conf = min(0.95, 0.4 + 0.4 * mean + 0.25 * high - 0.1 * blank + (0.1 if constructs >= 3 else 0.0))
        if conf >= 0.5:
            lang, share = _language(body)
            out.append(_block(a, b, _zone_of(lang), conf, "syntax_score", lang, share))
    return out


def _merged(blocks: list[dict], lines: list[str]) -> list[dict]:
    """Neighbours of one type and method with only blank lines between them become one; markup in a file
    of a templating language belongs to it."""
    out: list[dict] = []
    for b in sorted(blocks, key=lambda x: x["start_line"]):
        p = out[-1] if out else None
        free = p is not None and not any(x.strip() for x in lines[p["end_line"] : b["start_line"]])
        host = p is not None and {p["zone_type"], b["zone_type"]} == {"code", "markup"} and {p["language_hint"], b["language_hint"]} & {"jsx", "tsx", "vue", "svelte", "php"}
        if free and p["method"] == b["method"] != "structural_fence" and (p["zone_type"] == b["zone_type"] and p["language_hint"] == b["language_hint"] or host):
            p |= {"end_line": b["end_line"], "confidence": max(p["confidence"], b["confidence"]), "zone_type": "code" if host else p["zone_type"]}
        else:
            out.append(dict(b))
    return out


def zones(text: str, structural: bool = True, formats: bool = True, syntax: bool = True, data: bool = True, prose: bool = True, least: float = 0.5) -> list[dict]:
    """The blocks of a text, by line; each step can be left out."""
    if not text.strip():
        return []
    lines = text.split("\n")
    claimed = [False] * len(lines)
    blocks: list[dict] = []

    def claim(new: list[dict]) -> None:
        for b in new:
            claimed[b["start_line"] : b["end_line"]] = [True] * (b["end_line"] - b["start_line"])
        blocks.extend(new)

    if prescreen(text):
        if structural:
            blocks += _fenced(lines, claimed)
        if formats:
            claim([_block(a, b, f[0], f[2], f"format_{f[1]}", f[1]) for a, b in regions(lines, claimed, 2) if (f := _format(lines[a:b]))])
        if syntax:
            scores = scoped(lines, smoothed(lines, claimed))
            kinds = [None if c else negative(x) for x, c in zip(lines, claimed)]
            errors = [k == "error" for k in kinds]
            for i, k in enumerate(kinds):
                if k:
                    scores[i] = 0.0
            # what stands indented between two error lines belongs to them
            at = [i for i, e in enumerate(errors) if e]
            for i, j in zip(at, at[1:]):
                if j - i <= 4 and all(x[:1] in (" ", "\t") or not x.strip() for x in lines[i + 1 : j]) and not any(claimed[i:j]):
                    for k in range(i + 1, j):
                        errors[k], scores[k] = True, 0.0
            free = [x for x, c in zip(lines, claimed) if not c and x.strip()]
            if free and sum(bool(_LIST.match(x)) for x in free) / len(free) > 0.7:
                scores = [min(s, 0.0) for s in scores]
            claim(_assembled(lines, scores, errors, claimed))
        blocks = _merged([b for b in blocks if b["confidence"] >= least], lines)
        claimed = [False] * len(lines)
        for b in blocks:
            claimed[b["start_line"] : b["end_line"]] = [True] * (b["end_line"] - b["start_line"])
    if data:
        claim([_block(a, b, "data", d[1], "data_detector", d[0]) for a, b in regions(lines, claimed, 1) if (d := _data(lines[a:b]))])
    if prose:
        claim([_block(a, b, "natural_language", _prose(lines[a:b]), "prose_detector") for a, b in regions(lines, claimed, None)])
    return sorted(blocks, key=lambda b: b["start_line"])


def with_zones(df: DataFrame, text: str = "text", new: str = "zones", **options) -> DataFrame:
    """``df`` and the array of zones of its text column."""
    from pyspark.sql.types import StructType

    at = df.columns.index(text)
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"{new} {BLOCK}").fields])

    def run(batches):
        for b in batches:
            got = [None if t is None else zones(t, **options) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, _ARROW)], names=schema.names)

    return df.mapInArrow(run, schema)


def summary(df: DataFrame, key: str, new: str = "zones") -> DataFrame:
    """(key, zone_type, lines, max_confidence) of every zone type of every text."""
    z = df.select(key, F.explode(new).alias("z"))
    return z.groupBy(key, F.col("z.zone_type").alias("zone_type")).agg(F.sum(F.col("z.end_line") - F.col("z.start_line")).alias("lines"), F.max("z.confidence").alias("max_confidence"))


def dominant(new: str = "zones"):
    """The zone type with the most lines, the first in name order of equal ones."""
    kinds = f"array_distinct(transform({new}, z_ -> z_.zone_type))"
    sized = f"transform({kinds}, k_ -> named_struct('n', -aggregate(filter({new}, z_ -> z_.zone_type = k_), 0, (a_, z_) -> a_ + z_.end_line - z_.start_line), 'k', k_))"
    return F.expr(f"array_min({sized}).k")
