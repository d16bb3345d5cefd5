"""Passes over sets of findings: each rewrites the findings of a column, in a fixed order.

A pass is the SQL of one select over a relation of findings, with windows over the column, so the whole
chain is one query with one shuffle by column_id.
"""

from __future__ import annotations

from ..functions import text as T
from ..functions.dialect import Dialect
from ..model import DOMAIN_DELTAS, DOMAIN_SIGNALS, FAMILY, SPECIFICITY, case
from ..patterns import profile_rules
from .engines import FIELDS

CHECKSUMS = ["ABA_ROUTING", "CANADIAN_SIN", "CREDIT_CARD", "DEA_NUMBER", "IBAN", "NPI", "VIN"]
COLLISIONS = [("SSN", "ABA_ROUTING"), ("SSN", "CANADIAN_SIN"), ("ABA_ROUTING", "CANADIAN_SIN"), ("NPI", "PHONE"), ("DEA_NUMBER", "IBAN")]
OVER_PHONE = "ABA_ROUTING BANK_ACCOUNT CANADIAN_SIN CREDIT_CARD DATE DATE_OF_BIRTH EIN IBAN IP_ADDRESS MAC_ADDRESS NATIONAL_ID NPI SSN VIN".split()
PHONE_HINTS = "cell contact_number fax mobile mobile_number phone phone_number tel telephone".split()
GAP = 0.15


def select(src: str, where: str = "", over: str = "", **changed: str) -> str:
    cols = ", ".join(f"{changed[f]} AS {f}" if f in changed else f for f in FIELDS)
    inner = f"(SELECT *, {over} FROM {src}) AS w_" if over else src
    return f"SELECT {cols} FROM {inner}" + (f" WHERE {where}" if where else "")


def _types(q: Dialect, types) -> str:
    return q.any_in("entity_type", list(types))


def _any(test: str) -> str:
    return f"max(CASE WHEN {test} THEN 1 ELSE 0 END) OVER (PARTITION BY column_id)"


def calibrated(q: Dialect, src: str) -> str:
    conf = """CASE WHEN engine = 'regex' AND matched <= 2 THEN confidence * 0.9 WHEN engine = 'regex' AND matched <= 5 THEN confidence * 0.95
WHEN engine = 'column_name' AND confidence >= 0.85 THEN confidence + 0.05 WHEN engine = 'column_name' AND confidence >= 0.7 THEN confidence + 0.03
WHEN engine = 'heuristic_stats' THEN confidence * 0.95 ELSE confidence END"""
    return select(src, confidence=f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {conf}))")


def merged(q: Dialect, src: str) -> str:
    """One finding for each detection (or entity) type: the highest authority, then confidence, then first."""
    return select(src, "r_ = 1", "row_number() OVER (PARTITION BY column_id, CASE WHEN detection_type <> '' THEN detection_type ELSE entity_type END ORDER BY authority DESC, confidence DESC, seq) AS r_")


def weighted(q: Dialect, src: str, raw: str, skip: str) -> str:
    """An authoritative engine silences others that disagree, and gains from those that agree. ``skip``: a
    relation of the column_ids that are heterogeneous text."""
    cols = ", ".join(f"f.{c} AS {c}" if c != "confidence" else "CASE WHEN act_ AND own_ = 1 THEN least(CAST(1 AS DOUBLE), f.confidence + 0.05 * coalesce(b.n, 0)) ELSE f.confidence END AS confidence" for c in FIELDS)
    # the merge keeps every finding of the highest authority, so the top is the same before and after it
    return f"""SELECT {cols} FROM (SELECT w.*, max(CASE WHEN w.authority = w.top_ THEN 1 ELSE 0 END) OVER (PARTITION BY w.column_id, w.entity_type) AS own_, w.top_ >= 8 AND e.engines >= 2 AND s.column_id IS NULL AS act_ FROM (SELECT *, max(authority) OVER (PARTITION BY column_id) AS top_ FROM {src}) w
JOIN (SELECT column_id, count(DISTINCT engine) AS engines FROM {raw} GROUP BY column_id) e ON w.column_id = e.column_id LEFT JOIN {skip} s ON w.column_id = s.column_id) f
LEFT JOIN (SELECT column_id, entity_type, count(DISTINCT engine) AS n FROM (SELECT *, max(authority) OVER (PARTITION BY column_id) AS top_ FROM {raw}) y WHERE authority < top_ GROUP BY column_id, entity_type) b
ON f.column_id = b.column_id AND f.entity_type = b.entity_type WHERE NOT (act_ AND f.authority < f.top_ AND f.top_ - f.authority >= 3 AND own_ = 0)"""


def model_only(q: Dialect, src: str, raw: str, skip: str) -> str:
    """A model's own findings go where another engine is sure of a different type."""
    cols = ", ".join(f"f.{c} AS {c}" for c in FIELDS)
    return f"""SELECT {cols} FROM {src} f LEFT JOIN (SELECT DISTINCT column_id FROM {raw} WHERE engine <> 'model' AND confidence >= 0.85) s ON f.column_id = s.column_id
LEFT JOIN (SELECT DISTINCT column_id, entity_type FROM {raw} WHERE engine <> 'model' AND confidence >= 0.85) t ON f.column_id = t.column_id AND f.entity_type = t.entity_type
LEFT JOIN {skip} k ON f.column_id = k.column_id WHERE k.column_id IS NOT NULL OR f.engine <> 'model' OR s.column_id IS NULL OR t.column_id IS NOT NULL"""


def collision(q: Dialect, src: str, a: str, b: str) -> str:
    """One pair: a checksum that mostly holds wins over a type without one, else a clear gap decides."""
    conf = lambda e: f"max(CASE WHEN entity_type = '{e}' THEN confidence END) OVER (PARTITION BY column_id)"
    ratio = lambda e: f"max(CASE WHEN entity_type = '{e}' AND {_types(q, CHECKSUMS)} AND matched >= 5 THEN CAST(validated AS DOUBLE) / matched END) OVER (PARTITION BY column_id)"
    loser = f"""CASE WHEN ca_ IS NULL OR cb_ IS NULL THEN '' WHEN ra_ IS NOT NULL AND rb_ IS NULL AND ra_ >= 0.5 AND cb_ < 0.9 THEN '{b}' WHEN rb_ IS NOT NULL AND ra_ IS NULL AND rb_ >= 0.5 AND ca_ < 0.9 THEN '{a}'
WHEN abs(ca_ - cb_) < {GAP} THEN '' WHEN ca_ > cb_ THEN '{b}' ELSE '{a}' END"""
    return select(src, f"entity_type <> {loser}", f"{conf(a)} AS ca_, {conf(b)} AS cb_, {ratio(a)} AS ra_, {ratio(b)} AS rb_")


def phone(q: Dialect, src: str, columns: str) -> str:
    """PHONE goes where a type made of digits was found, unless the column is named for phones."""
    cols = ", ".join(f"f.{c} AS {c}" for c in FIELDS)
    name = q.replace("lower(c.column_name)", "[- ]", "_")
    return f"SELECT {cols} FROM (SELECT *, {_any(_types(q, OVER_PHONE))} AS w_ FROM {src}) f JOIN {columns} c ON f.column_id = c.column_id WHERE NOT (f.entity_type = 'PHONE' AND f.w_ = 1 AND NOT {T.contains_any(q, name, PHONE_HINTS)})"


def generic(q: Dialect, src: str) -> str:
    """CREDENTIAL goes where any other finding is as sure."""
    return select(src, "entity_type <> 'CREDENTIAL' OR o_ IS NULL OR o_ < g_", "max(CASE WHEN entity_type = 'CREDENTIAL' THEN confidence END) OVER (PARTITION BY column_id) AS g_, max(CASE WHEN entity_type <> 'CREDENTIAL' THEN confidence END) OVER (PARTITION BY column_id) AS o_")


def in_urls(q: Dialect, src: str) -> str:
    """Addresses and dates that only stand inside URLs go."""
    return select(src, f"NOT ({_types(q, ['IP_ADDRESS', 'DATE', 'DATE_OF_BIRTH'])} AND {q.size('matches')} > 0 AND {q.every('matches', 'x_', q.like('trim(x_)', '(?i)^https?://'))})")


def noise(q: Dialect, src: str) -> str:
    """Credentials all of whose values are configuration words or placeholders go."""
    value = f"({q.any_in('lower(trim(x_))', T.CONFIG_VALUES)} OR {T.placeholder(q, 'x_')})"
    members = [e for e, f in FAMILY.items() if f == "CREDENTIAL"]
    return select(src, f"NOT ({_types(q, members)} AND {q.size('matches')} > 0 AND {q.every('matches', 'x_', value)})")


def shapes(q: Dialect, src: str, columns: str) -> str:
    """(column_id, shape, n_types, hinted): structured_single, free_text_heterogeneous or opaque_tokens. Needs ``profile``."""
    name = f"lower({T.normalised(q, 'c.column_name')})"
    free = q.like(name, "(^|_)(body|comment|comments|content|description|log|message|messages|note|notes|payload|raw|text)(_|$)")
    band = "p.length_norm BETWEEN 0.3 AND 0.45 AND p.word_ratio >= 0.05 AND p.word_ratio < 0.1"
    return f"""SELECT c.column_id, CASE WHEN {band} AND {free} THEN 'free_text_heterogeneous' WHEN {band} AND d.column_id IS NOT NULL AND coalesce(t.n, 0) <= 1 THEN 'structured_single' WHEN p.length_norm < 0.3 AND coalesce(t.n, 0) <= 1 THEN 'structured_single' WHEN p.word_ratio >= 0.1 THEN 'free_text_heterogeneous' ELSE 'opaque_tokens' END AS shape,
CAST(coalesce(t.n, 0) AS INT) AS n_types, {band} AND ({free} OR (d.column_id IS NOT NULL AND coalesce(t.n, 0) <= 1)) AS hinted
FROM {columns} c JOIN profile p ON c.column_id = p.column_id LEFT JOIN (SELECT column_id, count(DISTINCT entity_type) AS n FROM {src} GROUP BY column_id) t ON c.column_id = t.column_id LEFT JOIN (SELECT DISTINCT column_id FROM nr WHERE r = 1) d ON c.column_id = d.column_id"""


def weak_checksums(q: Dialect, src: str, shape: str) -> str:
    """In a column of one thing, a checksum that mostly fails is a coincidence."""
    cols = ", ".join(f"f.{c} AS {c}" for c in FIELDS)
    return f"SELECT {cols} FROM {src} f LEFT JOIN {shape} s ON f.column_id = s.column_id WHERE NOT (coalesce(s.shape, '') = 'structured_single' AND f.engine = 'regex' AND {q.any_in('f.entity_type', CHECKSUMS)} AND coalesce(f.matched, 0) >= 10 AND coalesce(CAST(f.validated AS DOUBLE) / f.matched, 1) < 0.25)"


def with_entropy(q: Dialect, src: str, shape: str) -> str:
    """Columns of opaque tokens without a finding get that of the entropy engine."""
    cols = ", ".join(f"e.{c} AS {c}" for c in FIELDS)
    return f"SELECT {', '.join(FIELDS)} FROM {src} UNION ALL SELECT {cols} FROM by_entropy e JOIN {shape} s ON e.column_id = s.column_id LEFT JOIN (SELECT DISTINCT column_id FROM {src}) f ON e.column_id = f.column_id WHERE s.shape = 'opaque_tokens' AND f.column_id IS NULL"


def united(q: Dialect, src: str, extra: str, shape: str) -> str:
    """Findings of single values (of a model) in columns of free text join the others; of one type the surer one stays, the
    earlier of equal ones."""
    cols = ", ".join(FIELDS)
    both = f"SELECT {cols}, 0 AS late_ FROM {src} UNION ALL SELECT {', '.join(f'x.{c} AS {c}' for c in FIELDS)}, 1 AS late_ FROM {extra} x JOIN {shape} s ON x.column_id = s.column_id WHERE s.shape = 'free_text_heterogeneous'"
    # only what comes from outside may replace: findings of one type by several detections stay
    return f"""SELECT {cols} FROM (SELECT *, max(CASE WHEN late_ = 0 THEN confidence END) OVER (PARTITION BY column_id, entity_type) AS own_, max(CASE WHEN late_ = 1 THEN confidence END) OVER (PARTITION BY column_id, entity_type) AS new_ FROM ({both}) u_) v_
WHERE CASE WHEN late_ = 0 THEN new_ IS NULL OR own_ >= new_ ELSE own_ IS NULL OR new_ > own_ END"""


def directive(q: Dialect, src: str, predicted: str, rules=None) -> str:
    """A second-stage model's type for a column (``predicted``: column_id, entity_type, confidence) becomes its first finding,
    if the model is sure enough and the column has findings: an existing one is promoted, else one is made from the profile."""
    cols = ", ".join(FIELDS)
    seen: dict[str, tuple] = {}
    for e, c, s, _, regs, _ in profile_rules() if rules is None else rules:
        seen.setdefault(e, (c, s, regs))
    noted = f"""SELECT f.*, p.entity_type AS p_e, p.confidence AS p_c, max(f.confidence) OVER (PARTITION BY f.column_id) AS top_, row_number() OVER (PARTITION BY f.column_id ORDER BY f.confidence DESC, f.seq) AS rn_, row_number() OVER (PARTITION BY f.column_id, f.entity_type ORDER BY f.seq) AS re_
FROM {src} f LEFT JOIN {predicted} p ON f.column_id = p.column_id AND p.entity_type NOT IN ('', 'NEGATIVE') AND p.confidence >= 0.5"""
    judged = f"SELECT *, max(CASE WHEN rn_ = 1 THEN entity_type END) OVER (PARTITION BY column_id) AS te_, max(CASE WHEN entity_type = p_e THEN 1 ELSE 0 END) OVER (PARTITION BY column_id) AS has_ FROM ({noted}) n_"
    acts = f"SELECT *, p_e IS NOT NULL AND te_ <> p_e AND NOT (top_ >= 0.8 AND top_ >= p_c) AS act_ FROM ({judged}) j_"
    mine = "act_ AND has_ = 1 AND entity_type = p_e"
    changed = {"confidence": f"CASE WHEN {mine} THEN least(CAST(1 AS DOUBLE), greatest(top_ + 0.01, p_c)) ELSE confidence END", "engine": f"CASE WHEN {mine} THEN 'second_stage' ELSE engine END"}
    kept = f"SELECT {', '.join(f'{changed[f]} AS {f}' if f in changed else f for f in FIELDS)} FROM ({acts}) a_ WHERE NOT ({mine} AND re_ > 1)"
    of = lambda k: "CASE p_e " + " ".join(f"WHEN '{e}' THEN {q.text(x[k])}" for e, x in seen.items()) + " END"
    regs = "CASE p_e " + " ".join(f"WHEN '{e}' THEN {q.texts(x[2])}" for e, x in seen.items()) + " END"
    given = dict(entity_type="p_e", category=of(0), sensitivity=of(1), confidence="p_c", regulatory=regs, engine="'second_stage'", authority="0", seq="0", detection_type="''", matched="CAST(NULL AS BIGINT)", validated="CAST(NULL AS BIGINT)", scanned="CAST(NULL AS BIGINT)", matches=q.texts([]))
    new = f"SELECT {', '.join(f'{given[f]} AS {f}' if f in given else f for f in FIELDS)} FROM ({acts}) b_ WHERE act_ AND has_ = 0 AND rn_ = 1 AND {q.any_in('p_e', list(seen))}"
    return f"SELECT {cols} FROM ({kept}) k_ UNION ALL SELECT {cols} FROM ({new}) m_"


def gate(q: Dialect, src: str, raw: str) -> str:
    """(column_id, fired, reason, primary_entity): whether a credential was found beyond doubt; observed only."""
    top = lambda where: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_id ORDER BY confidence DESC, seq) AS r_ FROM {where}) x_ WHERE r_ = 1)"
    regex, secret = "coalesce(x.confidence, 0)", "coalesce(s.confidence, 0)"
    ratio = "coalesce(CAST(x.matched AS DOUBLE) / x.scanned, 0)"
    cred = "coalesce(t.category, '') = 'Credential'"
    a, b = f"({cred} AND {regex} >= 0.85 AND {ratio} >= 0.3)", f"({secret} >= 0.5)"
    return f"""SELECT c.column_id, {a} OR {b} AS fired, CASE WHEN {a} AND {b} THEN 'regex+ratio+secret_scanner' WHEN {a} THEN 'regex+ratio' WHEN {b} THEN 'secret_scanner' WHEN {cred} AND {regex} < 0.85 THEN 'regex_confidence_low' WHEN {cred} AND {ratio} < 0.3 THEN 'regex_match_ratio_low' ELSE 'no_tier1_signal' END AS reason, coalesce(t.entity_type, '') AS primary_entity
FROM (SELECT DISTINCT column_id FROM {raw}) c LEFT JOIN {top(src)} t ON c.column_id = t.column_id LEFT JOIN {top(f"(SELECT * FROM {raw} WHERE engine = 'regex') r_")} x ON c.column_id = x.column_id LEFT JOIN {top(f"(SELECT * FROM {raw} WHERE engine = 'secret_scanner') q_")} s ON c.column_id = s.column_id WHERE {cred} OR {b}"""


def siblings(q: Dialect, src: str, columns: str, least: float) -> str:
    """Other columns of the group tell its domain, which shifts some types. A window total less the
    column's own share stands for the leave-one-out profile: no self-join."""
    strong = lambda d: f"CASE WHEN confidence >= 0.7 AND {_types(q, DOMAIN_SIGNALS[d])} THEN 1 ELSE 0 END"
    sums = ", ".join(f"sum({strong(d)}) OVER (PARTITION BY group_id) AS all_{d}, sum({strong(d)}) OVER (PARTITION BY group_id) - sum({strong(d)}) OVER (PARTITION BY column_id) AS rest_{d}" for d in DOMAIN_SIGNALS)

    def primary(kind: str) -> str:
        out = "CASE"
        for d in DOMAIN_SIGNALS:
            others = " AND ".join(f"{kind}_{d} > {kind}_{o}" for o in DOMAIN_SIGNALS if o != d)
            out += f" WHEN {kind}_{d} >= 2 AND {others} THEN '{d}'"
        return out + " ELSE '' END"

    delta = "CASE " + " ".join(f"WHEN domain_ = '{d}' AND entity_type = '{e}' THEN {x}" for d, ds in DOMAIN_DELTAS.items() for e, x in ds.items()) + " ELSE 0 END"
    fields = ", ".join(f"f.{c}" for c in FIELDS)
    inner = f"(SELECT *, CASE WHEN {primary('all')} = '' THEN '' ELSE {primary('rest')} END AS domain_ FROM (SELECT {fields}, c.group_id, {sums.replace('(PARTITION BY column_id)', '(PARTITION BY f.column_id)')} FROM {src} f JOIN {columns} c ON f.column_id = c.column_id) a_) AS b_"
    moved = f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), confidence + {delta}))"
    return select(inner, f"{delta} = 0 OR {moved} >= {least}", confidence=f"CASE WHEN {delta} = 0 THEN confidence ELSE {moved} END", detection_type=f"CASE WHEN {delta} = 0 THEN detection_type ELSE '' END")


def table_profile(q: Dialect, src: str, columns: str) -> str:
    """(group_id, domain counts, primary_domain, signals): what the sure findings of a group say of it; a domain
    is primary with two signals at least and more than any other."""
    n = ", ".join(f"sum(CASE WHEN {_types(q, ts)} THEN 1 ELSE 0 END) AS {d}" for d, ts in DOMAIN_SIGNALS.items())
    primary = "CASE " + " ".join(f"WHEN {d} >= 2 AND " + " AND ".join(f"{d} > {o}" for o in DOMAIN_SIGNALS if o != d) + f" THEN '{d}'" for d in DOMAIN_SIGNALS) + " END"
    return f"SELECT group_id, {', '.join(f'CAST({d} AS BIGINT) AS {d}' for d in DOMAIN_SIGNALS)}, {primary} AS primary_domain, signals, types_seen FROM (SELECT c.group_id, {n}, count(*) AS signals, count(DISTINCT entity_type) AS types_seen FROM {src} f JOIN {columns} c ON f.column_id = c.column_id WHERE confidence >= 0.7 GROUP BY c.group_id) p_"


def classification_events(q: Dialect, src: str, run_id: str) -> str:
    """One event for each column with findings: how many, the surest, and which engines spoke."""
    return f"SELECT {q.text(run_id)} AS run_id, column_id, count(*) AS findings, max(confidence) AS top_confidence, count(DISTINCT engine) AS engines, min(entity_type) AS first_type FROM {src} GROUP BY column_id"


def ranked(q: Dialect, src: str, most: int | None = None, gap: float = 0.3, aggressive: bool = False) -> str:
    """Findings in order, with ``family`` and ``place``: families by their best finding, within one the more
    specific first; then the first ``most``, or those within ``gap`` of the best."""
    fam, spec = case("entity_type", FAMILY, "entity_type"), case("entity_type", SPECIFICITY, "0")
    near = f"CASE WHEN top_ > 0.8 THEN {min(gap, 0.15)} ELSE {gap} END" if aggressive else str(gap)
    keep = f"place <= {most}" if most is not None else f"top_ - confidence <= {near} + 1e-9"
    return f"""SELECT {', '.join(FIELDS)}, family, place FROM (SELECT *, row_number() OVER (PARTITION BY column_id ORDER BY first_, spec_ DESC, confidence DESC, rn_) AS place FROM (SELECT *, min(rn_) OVER (PARTITION BY column_id, family) AS first_ FROM
(SELECT *, {fam} AS family, {spec} AS spec_, max(confidence) OVER (PARTITION BY column_id) AS top_, row_number() OVER (PARTITION BY column_id ORDER BY confidence DESC, seq) AS rn_ FROM {src}) a_) b_) c_ WHERE {keep}"""


#: Steps that later ones refer to more than once; all are as small as the number of columns.
CUTS = ("profile", "raw", "f6", "f11", "shape")


def steps(q: Dialect, raw: str, columns: str, least: float = 0.5, categories: list[str] | None = None, per_value: str | None = None, predicted: str | None = None, rules=None) -> list[tuple[str, str]]:
    """The chain from the engines' findings to ``final``. Needs ``profile``, ``nr`` and ``by_entropy``. ``per_value``: a
    relation of findings of a model on single values; ``predicted``: one of a second-stage model's types."""
    out = [
        ("hetero", "SELECT column_id FROM profile WHERE word_ratio >= 0.1"),
        ("f2", calibrated(q, raw)),
        ("f3", merged(q, "f2")),
        ("f5", weighted(q, "f3", "f2", "hetero")),
        ("f6", model_only(q, "f5", "f2", "hetero")),
    ]
    at = "f6"
    for k, (a, b) in enumerate(COLLISIONS):
        out.append((f"f7{k}", collision(q, at, a, b)))
        at = f"f7{k}"
    out += [
        ("f8", phone(q, at, columns)),
        ("f9", generic(q, "f8")),
        ("f10", in_urls(q, "f9")),
        ("f11", noise(q, "f10")),
        ("shape", shapes(q, "f11", columns)),
        *([("f13", united(q, "f11", per_value, "shape"))] if per_value else []),
        ("f14", with_entropy(q, "f13" if per_value else "f11", "shape")),
        ("f15", weak_checksums(q, "f14", "shape")),
        *([("f16", directive(q, "f15", predicted, rules))] if predicted else []),
        ("f18", select("f16" if predicted else "f15", f"confidence >= {least}")),
        ("f19", siblings(q, "f18", columns, least)),
        ("final", select("f19", q.any_in("category", categories) if categories else "")),
    ]
    return out
