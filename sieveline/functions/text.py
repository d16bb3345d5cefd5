"""String statistics, scores, masks and the "not a secret" predicates, in both dialects.

Letters and digits are those of ASCII here; other characters count as special ones.
"""

from __future__ import annotations

import re

from ..patterns import key_names, placeholders
from .dialect import Dialect

ANTI_INDICATORS = ("changeme", "example", "placeholder", "test")
NOT_SECRET_KEYS = "_address _count _dir _endpoint _field _file _format _id _input _label _length _mode _name _path _placeholder _prefix _size _status _suffix _type _url".split()
SECRET_ANYWAY = ["auth_id", "client_id", "session_id"]
CONFIG_VALUES = "debug default development disabled enabled error example false info localhost nan no none null off on production sample staging test testing trace true undefined warn yes".split()


def _share(n: str, total: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN -(CAST({n} AS DOUBLE) / {total}) * log2(CAST({n} AS DOUBLE) / {total}) ELSE 0.0 END)"


def entropy(q: Dialect, v: str) -> str:
    """Shannon entropy in bits a character. The engine counts the runs of the sorted characters, in one pass over the
    text and not one for each of its characters."""
    if q.spark:
        runs = rf"regexp_extract_all(array_join(sort_array({q.chars(v)}), ''), r'(?s)(.)\1*', 0)"
        share = "CAST(length(x_) AS DOUBLE) / n_"
        return f"(CASE WHEN {v} = '' THEN CAST(0 AS DOUBLE) ELSE element_at(transform(array(length({v})), n_ -> aggregate({runs}, 0D, (a_, x_) -> a_ - {share} * log2({share}))), 1) END)"
    one = f"(length({v}) - length(replace({v}, c_, '')))"
    return f"(CASE WHEN {v} = '' THEN CAST(0 AS DOUBLE) ELSE {q.sum(q.map(q.distinct(q.chars(v)), 'c_', q.double(_share(one, f'length({v})'))))} END)"


def charset(q: Dialect, v: str) -> str:
    return f"(CASE WHEN {q.like(v, '^[0-9A-Fa-f]+$')} THEN 'hex' WHEN {q.like(v, '^[0-9A-Za-z+/=]+$')} THEN 'base64' ELSE 'full' END)"


def relative_entropy(q: Dialect, v: str) -> str:
    most = f"(CASE {charset(q, v)} WHEN 'hex' THEN 4.0 WHEN 'base64' THEN 6.0 ELSE log2(95.0) END)"
    return f"least(CAST(1 AS DOUBLE), {entropy(q, v)} / {q.double(most)})"


def relative_score(rel: str) -> str:
    return f"(CASE WHEN {rel} < 0.5 THEN CAST(0 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), {rel}) END)"


def classes(q: Dialect, v: str) -> list[str]:
    """Counts of upper-case, lower-case, digit and other characters."""
    return [f"length({q.replace(v, p)})" for p in ("[^A-Z]", "[^a-z]", "[^0-9]", "[0-9A-Za-z]")]


def diversity(q: Dialect, v: str) -> str:
    return "(" + " + ".join(f"CAST({n} > 0 AS INT)" for n in classes(q, v)) + ")"


def evenness(q: Dialect, v: str) -> str:
    h = " + ".join(_share(n, f"length({v})") for n in classes(q, v))
    return f"(CASE WHEN {diversity(q, v)} > 1 THEN ({h}) / log2(CAST({diversity(q, v)} AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END)"


def camel_to_snake(q: Dialect, v: str) -> str:
    by = "$1_$2" if q.spark else r"\1_\2"
    return f"lower({q.replace(v, '([0-9a-z])([A-Z])', by)})"


def normalised(q: Dialect, v: str) -> str:
    """A column name as the dictionary has it."""
    one, two = ("$1_$2", "$1_$2") if q.spark else (r"\1_\2", r"\1_\2")
    # the second split needs no look-ahead: an upper-case letter before an upper-lower pair
    split = q.replace(q.replace(v, "([a-z])([A-Z])", one), "([A-Z])([A-Z][a-z])", two)
    return q.replace(q.replace(f"lower({split})", "[-_ ]+", "_"), "^_+|_+$", "")


def mask(q: Dialect, v: str, entity: str) -> str:
    """A sampled value with most of it hidden."""
    n = f"length({v})"
    at = f"(strpos({v}, '@') - 1)" if not q.spark else f"(instr({v}, '@') - 1)"
    return f"""(CASE WHEN {n} <= 4 THEN repeat('*', {n})
WHEN {entity} IN ('SSN', 'NATIONAL_ID', 'CREDIT_CARD', 'BANK_ACCOUNT', 'PHONE') THEN concat(repeat('*', {n} - 4), right({v}, 4))
WHEN {entity} = 'EMAIL' AND {at} > 1 THEN concat(left({v}, 1), repeat('*', CAST({at} - 1 AS INT)), substr({v}, CAST({at} + 1 AS INT)))
WHEN {entity} = 'EMAIL' THEN repeat('*', {n})
ELSE concat(left({v}, 1), repeat('*', {n} - 2), right({v}, 1)) END)"""


def mask_text(q: Dialect, v: str) -> str:
    """A value found in text: its first and last four characters, if there are more than eight."""
    n = f"length({v})"
    return f"(CASE WHEN {n} <= 8 THEN repeat('*', {n}) ELSE concat(left({v}, 4), repeat('*', {n} - 8), right({v}, 4)) END)"


def url_decoded(q: Dialect, v: str) -> str:
    return f"coalesce(try_url_decode({v}), {v})" if q.spark else f"url_decode({v})"


def contains_any(q: Dialect, v: str, parts) -> str:
    return "(" + " OR ".join(q.contains(v, p) for p in parts) + ")"


def anti_indicated(q: Dialect, key: str, value: str) -> str:
    return f"({contains_any(q, f'lower({key})', ANTI_INDICATORS)} OR {contains_any(q, f'lower({value})', ANTI_INDICATORS)})"


def compound_key(q: Dialect, key: str) -> str:
    """A key that names something about a secret rather than one."""
    return f"({q.like(f'lower(trim({key}))', '(' + '|'.join(NOT_SECRET_KEYS) + ')$')} AND NOT {q.any_in(f'lower(trim({key}))', SECRET_ANYWAY)})"


_PLACEHOLDERS = [
    "(?i)x{5,}", "<[^>]{1,80}>", r"(?i)^\[[_A-Z]{2,}\]$", r"(?i)your[-_\s].*(credential|key|password|secret|token)", r"(?i)(insert|put)[-_\s]?your", r"(?i)replace[-_\s]?(me|this|with)", "(?i)placeholder", "(?i)redacted",
    "(?i)%bexample%b", "(?i)^sample[-_]", "(?i)^dummy", r"\{\{.*\}\}", r"\$\{[_A-Z]+\}", "(?i)example$", r"(?i)(key|password|secret|token)[-_\s]here", r"(?i)goes[-_\s]here", "(?i)%b(changeme|fixme|foobar|todo)%b",
]
_RUN = "|".join(f"{c}{{8,}}" for c in [*"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *(rf"\x{ord(c):02x}" for c in " !\"#$%&'()*+,-./:;<=>?@[]^_`{|}~")])


def placeholder(q: Dialect, v: str) -> str:
    """A value that stands for a secret, or eight equal characters in a row."""
    run = r"([ -\[\]-~])\1{7}" if q.spark else _RUN  # one look at each character, where the engine has back references
    return f"({' OR '.join(q.like(v, p) for p in [*_PLACEHOLDERS, run])} OR {q.any_in(f'lower({v})', placeholders())})"


_NAME = r"[a-zA-Z_]\w*"
#: Name -> pattern, or builder, of what is obviously no secret.
NOT_SECRET = {
    "config_literal": lambda q, v: q.any_in(f"lower(trim({v}))", CONFIG_VALUES),
    "url": "(?i)^https?://",
    "date": r"^\d{4}([-/]\d\d){2}",
    "ip": r"^\d{1,3}(\.\d{1,3}){3}$",
    "numeric": r"^[-\d\s.,+]+$",
    "dotted_code": lambda q, v: f"({q.like(v, rf'^{_NAME}(\.{_NAME})+[;,]?$')} AND NOT {q.like(v, r'[^.;,]{33}')})",
    "bracket_access": rf"^{_NAME}(\.{_NAME})*\[[^\]]+\][,;]?$",
    "statement": rf"^{_NAME};$",
    "call_assignment": r"[({].*[=;]",
    "shell_variable": lambda q, v: f"({q.like(v, r'^\$[\w{]')} AND NOT {q.like(v, r'^\$(argon2|scrypt|2[aby]\$|[56]\$)')})",
    "constant": r"^[A-Z][0-9A-Z]*([-_][0-9A-Z]+)+$",
    "punctuation": r"^[-!@#%^&*+=~`;:,.|/\\<>(){}\[\]\s]+$",
    "file_path": r"""^\s*["']*([/~][-\w./:+]+|[A-Z]:\\[-\w\\.:+]+)["']*\s*$""",
    "drive": r"""^\s*["']*[A-Za-z]:[/\\]""",
    "qualified_name": r"^[A-Za-z][^.]{0,49}(\.[A-Za-z][^.]{0,49}){2,}\.[A-Za-z][^.]{0,49}?[;,()]*$",
    "relative_url": r"^//\w",
    "domain_path": r"^[a-z][-a-z0-9]*(\.[a-z][-a-z0-9]*){2,}/",
    "html_attribute": r"""(?i)^(action|class|data-\w+|href|id|integrity|src)\s*=\s*\x22""",
    "integrity_hash": "^sha(512|384|256)-[0-9A-Za-z/+=]+$",
    "fingerprint": "^SHA(256|384|512):",
    "camel_case": lambda q, v: f"(length({q.replace(v, '[^A-Za-z]')}) > 0.9 * length({v}) AND {q.size(q.all(v, '[A-Z][a-z]{3,}'))} >= 3)",
    "bytecode": "^L[a-z][0-9a-z]*/",
    "dict_access": rf"^{_NAME}(\.{_NAME})*\[",
    "function_call": lambda q, v: f"({q.like(v, r'^[A-Za-z_!][\w:.]*\(')} AND NOT {q.contains(v, ' ')})",
    "namespace": "^(xmlns|cargo):",
    "key_path": r"""^[-\w]+=\x22(/|~/|\.\.?/|\$|https?://)""",
    "file_url": "file://",
    "ethereum": "^0x[0-9A-Fa-f]{40}$",
    "relative_path": r"^\.\.?/",
    "flag_url": r"^--[-\w]+=https?://",
    "slash_words": r"^/*[A-Za-z][^/]{0,29}(/+[A-Za-z][^/]{0,29}){3,}/*$",
    "interpolation": r"\$\{",
    "validation_id": "^VUID-",
    "open_bracket": r"^[\[(]",
    "backslashes": r"\\.*\\",
    "format_url": r"^f['\x22]https?://",
    "single_word": lambda q, v: f"(length(trim({v})) <= 30 AND {q.like(f'trim({v})', '^[A-Za-z]+(-[A-Za-z]+)*$')})",
    "concatenation": r"""^\s*["']*\s*\+|\+\s*["']*\s*$""",
    "alphabet": lambda q, v: "(length({v}) >= 20 AND {n} >= 2)".format(v=v, n="(" + " + ".join(f"CAST({q.contains(v, s)} AS INT)" for s in ("abcdefghij", "ABCDEFGHIJ", "0123456789")) + ")"),
    "markdown_link": r"^!?\[.*\]\(",
    "url_encoded": "%[A-Fa-f0-9]{2}.*%[A-Fa-f0-9]{2}",
    "braces": lambda q, v: f"({q.contains(v, '{')} AND {q.contains(v, '}')})",
    "comma_list": r"^\s*[-\w]{1,40}\s*(,\s*[-\w]{1,40}\s*){3,}$",
    "prose": lambda q, v: f"({q.contains(v, ' ')} AND length({q.replace(v, '[^A-Za-z]')}) > 0.6 * length({v}))",
    "other_script": r"[\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{0900}-\x{0DFF}\x{0E00}-\x{0E7F}\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}]",
}


def not_secret_rule(q: Dialect, name: str, v: str) -> str:
    rule = NOT_SECRET[name]
    return q.like(v, rule) if isinstance(rule, str) else rule(q, v)


def obviously_not_secret(q: Dialect, v: str) -> str:
    return "(" + " OR ".join(not_secret_rule(q, n, v) for n in NOT_SECRET) + ")"


def _key_test(q: Dialect, key: str, pattern: str, kind: str) -> str:
    if kind == "word_boundary":
        return q.like(key, f"(^|[^0-9a-z]){pattern}([^0-9a-z]|$)")
    if kind == "suffix":
        return q.like(key, f"(^|[^0-9a-z]){pattern}$")
    return q.contains(key, pattern)


def key_score(q: Dialect, key: str) -> str:
    """(score, tier, subtype) of the best entry of the key dictionary, as "score|tier|subtype" text."""
    k = camel_to_snake(q, key)
    groups: dict[tuple, list[str]] = {}
    for p, kind, score, tier, subtype in key_names():
        groups.setdefault((score, tier, subtype), []).append(_key_test(q, "k_", p, kind))
    whens = " ".join(f"WHEN {' OR '.join(tests)} THEN '{s}|{t}|{b}'" for (s, t, b), tests in sorted(groups.items(), key=lambda x: -x[0][0]))
    body = f"(CASE {whens} ELSE '0.0||OPAQUE_SECRET' END)"
    return f"element_at({q.map(f'array({k})', 'k_', body)}, 1)" if q.spark else f"list_transform([{k}], lambda k_: {body})[1]"


def measures(q: Dialect, v: str) -> str:
    """Select list of what the scores need: rel_, div_, even_ and obvious_. Kept in a select of its own, so
    that each is computed once and no generated method grows too large."""
    return f"{relative_entropy(q, v)} AS rel_, {diversity(q, v)} AS div_, {evenness(q, v)} AS even_, {obviously_not_secret(q, v)} AS obvious_"


def tiered_score(score: str, tier: str) -> str:
    """Confidence that a value with these ``measures`` under a key of this score and tier is a secret."""
    bonus = "0.15 * even_ + 0.05 * greatest(0, div_ - 3)"
    return f"""(CASE WHEN obvious_ THEN CAST(0 AS DOUBLE)
WHEN {tier} = 'definitive' THEN {score} * 0.95
WHEN {tier} = 'strong' AND (rel_ >= 0.5 OR div_ >= 3) THEN least(CAST(1 AS DOUBLE), {score} * greatest(CAST(0.6 AS DOUBLE), {relative_score('rel_')}) + {bonus})
WHEN {tier} = 'contextual' AND rel_ >= 0.7 AND div_ >= 3 THEN least(CAST(1 AS DOUBLE), {score} * {relative_score('rel_')} + {bonus})
ELSE CAST(0 AS DOUBLE) END)"""


def opaque_confidence(q: Dialect, v: str, floor: float = 0.7, classes_: int = 3, base: float = 0.65, most: float = 0.85) -> str:
    """Confidence that a bare token with its ``measures`` is a secret; 0 if it is none."""
    gate = f"length({v}) BETWEEN 16 AND 512 AND rel_ >= {floor} AND div_ >= {classes_} AND NOT obvious_ AND NOT {q.like(v, '^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$')} AND NOT {contains_any(q, f'lower({v})', ANTI_INDICATORS)} AND NOT {placeholder(q, v)}"
    add = f"CAST({base} AS DOUBLE) + (CASE WHEN rel_ > 0.85 THEN 0.1 ELSE 0.0 END) + greatest(0, div_ - {classes_}) * 0.05 + (CASE WHEN length({v}) > 24 THEN 0.05 ELSE 0.0 END)"
    return f"(CASE WHEN {gate} THEN least(CAST({most} AS DOUBLE), {add}) ELSE CAST(0 AS DOUBLE) END)"


#: A line (without blanks around it) of a stack trace or error message, where names are no keys of assignments: frames of
#: several languages, cells, raised and named errors, panics.
_TRACE = r"(?:(?:in|at) [0-9A-Za-z_][0-9A-Za-z_.]*[(]|at\s+[0-9A-Za-z_.$]+[(]|(?:[Rr]aise)\s+[0-9A-Za-z_]|[0-9A-Za-z_]*(?:Error|Exception):|panic:|goroutine [0-9]|Cell In\[|Traceback [(]most recent|File \x22.+\x22, line [0-9])"
TRACE_LINE = re.compile(_TRACE)


def trace_line(q: Dialect, line: str) -> str:
    """Whether a line belongs to a stack trace or error message."""
    return q.like(f"trim({line})", f"^{_TRACE}")


def context_adjustment(q: Dialect, v: str, boost: list[str], suppress: list[str]) -> str:
    """What words beside a match add to its confidence: 0.3 for a word that supports it, else -0.3 for one against."""
    words = q.split(f"lower({v})", r"\s+")
    test = lambda ws: q.overlap(words, q.texts([w.lower() for w in ws])) if ws else "false"
    return f"(CASE WHEN {test(boost)} THEN 0.3 WHEN {test(suppress)} THEN -0.3 ELSE 0.0 END)"
