"""Detection engines: (columns, samples) -> findings, one row for each label an engine gives a column.

``columns`` has (group_id, column_id, column_name, table_name, data_type), ``samples`` (column_id, pos,
value). A finding's ``seq`` orders findings as engines and rules are ordered.
"""

from __future__ import annotations

from ..functions import text as T
from ..functions import validators
from ..functions.dialect import Dialect
from ..model import NON_TEXT_TYPES
from ..patterns import column_variants, content_patterns, profile_rules, screen, stopwords

ABBREVIATIONS = {
    a: full
    for full, names in {
        "date_of_birth": "dob", "credit_card": "cc cc_num cc_no ccn", "drivers_license": "dl", "dl_number": "dl_num dl_no", "first_name": "fn fname", "last_name": "ln lname", "address": "addr", "account_number": "acct acct_num acct_no", "password": "pwd passwd",
        "telephone": "tel", "mobile": "mob", "phone": "ph", "phone_number": "ph_num", "social_security_number": "ssn", "dea_number": "dea", "npi_number": "npi", "medicare_beneficiary": "mbi", "medical_record_number": "mrn", "vehicle_identification_number": "vin",
        "employer_identification_number": "ein", "social_insurance_number": "sin", "ip_address": "ip", "iban": "iban", "bic_code": "bic", "bitcoin_address": "btc", "ethereum_address": "eth", "aba_routing": "aba",
    }.items()
    for a in names.split()
}
#: Words of a table's name that support a category.
TABLE_WORDS = {
    w: c
    for c, ws in {
        "PII": "client clients contact contacts customer customers employee employees member members people person personnel persons profile profiles staff user users",
        "Health": "clinical diagnoses diagnosis encounter encounters lab labs medical patient patients prescription prescriptions",
        "Financial": "account accounts billing invoice invoices ledger order orders payment payments payroll salaries salary transaction transactions",
    }.items()
    for w in ws.split()
}
FIELDS = "column_id entity_type category sensitivity confidence regulatory engine authority seq detection_type matched validated scanned matches".split()


def _finding(q: Dialect, **x: str) -> str:
    none = {"regulatory": q.texts([]), "detection_type": "''", "matched": "CAST(NULL AS BIGINT)", "validated": "CAST(NULL AS BIGINT)", "scanned": "CAST(NULL AS BIGINT)", "matches": q.texts([])}
    return ", ".join(f"{(none | x)[f]} AS {f}" for f in FIELDS)


def by_name(q: Dialect, columns: str, least: float = 0.5) -> list[tuple[str, str]]:
    """Column names against the dictionary: as they are, expanded, and by their longest, leftmost run of words."""
    words = column_variants()
    abbreviated = {a: words[f] for a, f in ABBREVIATIONS.items() if f in words}
    rows = [(n, 0, *w) for n, w in words.items()] + [(a, 1, *w) for a, w in abbreviated.items()]
    table = T.normalised(q, "coalesce(table_name, '')")
    support = " OR ".join(f"(category = '{c}' AND {q.overlap('table_words', q.texts([w for w, k in TABLE_WORDS.items() if k == c]))})" for c in ("PII", "Health", "Financial"))
    return [
        ("nd", f"SELECT * FROM {q.values(rows, ['variant', 'short', 'entity_type', 'category', 'sensitivity', 'base'])}"),
        ("nn", f"SELECT column_id, {q.split(T.normalised(q, 'column_name'), '_')} AS words, {q.split(table, '_')} AS table_words FROM {columns}"),
        ("nl", f"SELECT *, {q.explode(q.range(q.size('words')))} AS size_ FROM nn"),
        ("ns", f"SELECT *, {q.explode(q.range(f'{q.size("words")} - size_ + 1'))} AS start_ FROM nl"),
        ("ng", f"SELECT *, {q.joined('words', 'start_', 'size_', '_')} AS gram FROM ns"),
        ("nr", f"SELECT g.*, d.*, row_number() OVER (PARTITION BY column_id ORDER BY size_ DESC, start_, short) AS r FROM ng g JOIN nd d ON g.gram = d.variant"),
        ("nc", f"SELECT *, least(CAST(1 AS DOUBLE), base * (CASE WHEN short = 1 THEN 0.95 ELSE 1.0 END) * (CASE WHEN size_ < {q.size('words')} THEN 0.85 ELSE 1.0 END) + (CASE WHEN {support} THEN 0.05 ELSE 0.0 END)) AS conf FROM nr WHERE r = 1"),
        ("by_name", f"SELECT {_finding(q, column_id='column_id', entity_type='entity_type', category='category', sensitivity='sensitivity', confidence=q.double('conf'), engine=q.text('column_name'), authority='10', seq='1000')} FROM nc WHERE conf >= {least}"),
    ]


def by_profile_rule(q: Dialect, columns: str, rules=None) -> list[tuple[str, str]]:
    """Column names against the regular expressions of a profile (the standard one, if none is given); the first rule wins."""
    rules = profile_rules() if rules is None else rules
    if not rules:
        return [("by_rule", f"SELECT {_finding(q, column_id='column_id', entity_type=q.text(''), category=q.text(''), sensitivity=q.text(''), confidence='CAST(0 AS DOUBLE)', engine=q.text('regex'), authority='5', seq='2000')} FROM {columns} WHERE false")]
    first = "CASE " + " ".join(f"WHEN {' OR '.join(q.like('lower(column_name)', p) for p in r[5])} THEN {k}" for k, r in enumerate(rules)) + " END"
    rows = [(k, e, c, s, conf) for k, (e, c, s, conf, _, _) in enumerate(rules)]
    regs = "CASE " + " ".join(f"WHEN rule = {k} THEN {q.texts(r[4])}" for k, r in enumerate(rules)) + " END"
    return [
        ("pr", f"SELECT column_id, {first} AS rule FROM {columns}"),
        ("by_rule", f"SELECT {_finding(q, column_id='p.column_id', entity_type='entity_type', category='category', sensitivity='sensitivity', confidence=q.double('conf'), regulatory=regs.replace('rule =', 'p.rule ='), engine=q.text('regex'), authority='5', seq='2000 + p.rule')} FROM pr p JOIN {q.values(rows, ['rule', 'entity_type', 'category', 'sensitivity', 'conf'])} d ON p.rule = d.rule"),
    ]


def screen_columns(q: Dialect, v: str) -> str:
    return f"lower({v}) AS low_, length({v}) AS size_, length({q.replace(v, '[^0-9]')}) AS digits_"


def screened(q: Dialect, regex: str) -> str:
    """What holds of any text with a match: a test of ``screen_columns`` that spares most the expression."""
    size, n, parts = screen(regex)
    return " AND ".join([f"size_ >= {size}"] + ([f"digits_ >= {n}"] if n else []) + ([T.contains_any(q, "low_", parts)] if parts else []))


_NO_STOPWORD = lambda q: f"NOT {q.any_in('lower(trim(value))', stopwords())}"


def by_content(q: Dialect, columns: str, samples: str, patterns=None, evidence: bool = True) -> list[tuple[str, str]]:
    """Values against the content patterns: matches, validated matches and confidence, moved by the words beside the matches.
    ``evidence``: keep the first five matches, for samples, which are bounded; over whole tables it is left out."""
    ps = content_patterns() if patterns is None else patterns
    hits = q.array([f"CASE WHEN {screened(q, p.regex)} AND {q.like('value', p.regex)} THEN {k} END" for k, p in enumerate(ps)])
    known = [(k, p) for k, p in enumerate(ps) if p.validator in validators.VALIDATORS]
    valid = "CASE p " + " ".join(f"WHEN {k} THEN {validators.VALIDATORS[p.validator](q, q.first('value', p.regex, 0))}" for k, p in known) + " ELSE true END" if known else "true"
    hinted = [(k, p) for k, p in enumerate(ps) if p.hints]
    gate = "CASE p " + " ".join(f"WHEN {k} THEN {T.contains_any(q, 'lower(column_name)', p.hints)}" for k, p in hinted) + " ELSE true END" if hinted else "true"
    known_false = [f"(p = {k} AND ({' OR '.join([q.like('value', a) for a in p.allow] + ([q.any_in('lower(trim(value))', [w.lower() for w in p.stop])] if p.stop else []))}))" for k, p in enumerate(ps) if p.allow or p.stop]
    worded = [(k, p) for k, p in enumerate(ps) if p.boost or p.suppress]
    moved = "avg(CASE p " + " ".join(f"WHEN {k} THEN {T.context_adjustment(q, 'value', list(p.boost), list(p.suppress))}" for k, p in worded) + " ELSE 0.0 END)" if worded else "0.0"
    rows = [(k, p.name, p.entity_type, p.category, p.sensitivity, p.confidence, int(bool(p.validator))) for k, p in enumerate(ps)]
    keep = "x_ IS NOT NULL"
    sure = "(CASE WHEN checked = 1 AND validated > 0 AND raw >= 0.7 THEN greatest(raw, CAST(0.95 AS DOUBLE)) ELSE raw END)"
    return [
        ("cv", f"SELECT column_id, pos, value, {screen_columns(q, 'value')} FROM {samples} WHERE value IS NOT NULL"),
        ("cn", "SELECT column_id, count(*) AS scanned FROM cv GROUP BY column_id"),
        ("ch", f"SELECT column_id, pos, value, {q.explode(q.filter(hits, 'x_', keep))} AS p FROM cv WHERE {_NO_STOPWORD(q)}"),
        ("ck", f"SELECT h.*, {valid} AS valid FROM ch h JOIN {columns} c ON h.column_id = c.column_id WHERE {gate}{' AND NOT (' + ' OR '.join(known_false) + ')' if known_false else ''}"),
        ("ca", f"SELECT column_id, p, count(*) AS matched, sum(CASE WHEN valid THEN 1 ELSE 0 END) AS validated, {q.double(moved)} AS moved_, {q.collect('value', 'pos', 5) if evidence else q.texts([])} AS matches FROM ck GROUP BY column_id, p"),
        ("cc", f"SELECT a.*, d.*, base * (CASE WHEN validated < matched THEN CAST(validated AS DOUBLE) / matched ELSE CAST(1 AS DOUBLE) END) AS raw FROM ca a JOIN {q.values(rows, ['id', 'name', 'entity_type', 'category', 'sensitivity', 'base', 'checked'])} d ON a.p = d.id"),
        ("by_content", f"SELECT {_finding(q, column_id='c.column_id', entity_type='entity_type', category='category', sensitivity='sensitivity', confidence=f'greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), moved_ + {sure}))' if worded else sure, engine=q.text('regex'), authority='5', seq='3000 + p', detection_type='name', matched='CAST(matched AS BIGINT)', validated='CAST(validated AS BIGINT)', scanned='CAST(n.scanned AS BIGINT)', matches='matches')} FROM cc c JOIN cn n ON c.column_id = n.column_id WHERE raw > 0"),
    ]


def searched_values(q: Dialect) -> str:
    """After the steps of ``by_content``: the values that its step ``ch`` matches, which ``matches.with_hits`` does for whole tables."""
    return f"SELECT column_id, pos, value FROM cv WHERE {_NO_STOPWORD(q)}"


def by_statistics(q: Dialect, least: float = 0.5) -> list[tuple[str, str]]:
    """Nine-digit columns: many different values are SSNs, few repeated ones routing numbers. Needs ``profile``."""
    ssn, aba = "least(CAST(0.95 AS DOUBLE), 0.7 + 0.15 * cardinality)", "least(CAST(0.9 AS DOUBLE), 0.75 + 0.1 * (1 - cardinality))"
    shape = "n_values >= 10 AND digit_ratio >= 0.95 AND uniform AND min_length = 9"
    one = lambda e, c, s, conf, regs, seq, test: f"SELECT {_finding(q, column_id='column_id', entity_type=q.text(e), category=q.text(c), sensitivity=q.text(s), confidence=q.double(f'round({conf}, 4)'), regulatory=q.texts(regs), engine=q.text('heuristic_stats'), authority='1', seq=seq)} FROM profile WHERE {shape} AND {test} AND {conf} >= {least}"
    return [("by_stats", one("SSN", "PII", "CRITICAL", ssn, ["HIPAA", "CCPA", "GDPR"], "5000", "cardinality >= 0.8") + " UNION ALL " + one("ABA_ROUTING", "Financial", "HIGH", aba, ["GLBA", "PCI-DSS"], "5001", "cardinality <= 0.05"))]


_PAIR = r"""([A-Za-z_][A-Za-z0-9_]*)\s*(?::=|:|=)\s*[\x22\x27]?([^\s\x22\x27,;]{8,500})"""


def by_secret(q: Dialect, columns: str, samples: str, least: float = 0.5) -> list[tuple[str, str]]:
    """Values under a secret's name: the column's own, or the key of the first assignment in a value."""
    key, val = q.first("value", _PAIR, 1), q.first("value", _PAIR, 2)
    where = f"length(value) BETWEEN 8 AND 500 AND NOT {T.anti_indicated(q, 'name', 'value')} AND NOT {T.placeholder(q, 'value')} AND NOT {T.compound_key(q, 'name')}"
    return [
        ("sp", f"SELECT column_id, pos, {key} AS name, {val} AS value FROM {samples} WHERE {q.like('value', _PAIR)} UNION ALL SELECT s.column_id, pos, column_name AS name, value FROM {samples} s JOIN {columns} c ON s.column_id = c.column_id WHERE value IS NOT NULL AND NOT {q.like('value', _PAIR)}"),
        ("sk", "SELECT name, " + T.key_score(q, "name") + " AS best FROM (SELECT DISTINCT name FROM sp) AS names_"),
        ("sq", f"SELECT p.column_id, pos, value, {q.double(f'{q.split("best", "[|]")}[{0 if q.spark else 1}]')} AS score, {q.split('best', '[|]')}[{1 if q.spark else 2}] AS tier, {q.split('best', '[|]')}[{2 if q.spark else 3}] AS subtype FROM sp p JOIN sk k ON p.name = k.name WHERE {where.replace('name', 'p.name')}"),
        ("sm", f"SELECT *, {T.measures(q, 'value')} FROM sq WHERE score > 0"),
        ("st", f"SELECT *, {T.tiered_score('score', 'tier')} AS conf FROM sm"),
        ("sn", f"SELECT column_id, count(*) AS scanned FROM {samples} WHERE value IS NOT NULL GROUP BY column_id"),
        ("sa", f"SELECT column_id, subtype, max(conf) AS conf, count(*) AS matched, {q.collect('value', 'pos', 5)} AS matches FROM st WHERE conf > 0 GROUP BY column_id, subtype"),
        ("by_secret", f"SELECT {_finding(q, column_id='a.column_id', entity_type='subtype', category=q.text('Credential'), sensitivity=q.text('CRITICAL'), confidence='round(conf, 4)', engine=q.text('secret_scanner'), authority='1', seq='6000', matched='CAST(matched AS BIGINT)', validated='CAST(matched AS BIGINT)', scanned='CAST(scanned AS BIGINT)', matches='matches')} FROM sa a JOIN sn n ON a.column_id = n.column_id WHERE conf >= {least}"),
    ]


def by_entropy(q: Dialect) -> list[tuple[str, str]]:
    """Columns at least half of whose values are opaque tokens. Needs ``profile``."""
    conf = "round(least(CAST(0.95 AS DOUBLE), 0.6 + 0.2 * greatest(CAST(0 AS DOUBLE), solid_entropy - 4.2) + 0.15 * opaque_ratio), 4)"
    return [("by_entropy", f"SELECT {_finding(q, column_id='column_id', entity_type=q.text('OPAQUE_SECRET'), category=q.text('Credential'), sensitivity=q.text('HIGH'), confidence=q.double(conf), regulatory=q.texts(['GDPR']), engine=q.text('entropy'), authority='1', seq='8000', matched='CAST(opaque AS BIGINT)', validated='CAST(opaque AS BIGINT)', scanned='CAST(solid AS BIGINT)')} FROM profile WHERE opaque_ratio >= 0.5")]


def text_columns(q: Dialect, columns: str) -> str:
    """Columns a text model would be asked about."""
    return f"SELECT * FROM {columns} WHERE NOT {q.any_in('upper(coalesce(data_type, %s))' % q.text(''), NON_TEXT_TYPES)}"
