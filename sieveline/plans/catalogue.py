"""The registered queries: one statement for both dialects where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T
from ..functions import validators
from ..functions.dialect import DUCK, SPARK, Dialect
from ..model import FAMILY, case
from ..operators import classify as C
from ..patterns import content_patterns
from ..operators import engines, matches, passes, profile, rollup
from ..sources.columns import long_sql, sample_sql
from .sql import chain, over, staged

#: name -> (tables, statement(dialect, **table names))
SQL: dict[str, tuple[tuple[str, ...], Callable[..., str]]] = {}


def sql(name: str, *tables: str):
    def keep(f):
        SQL[name] = (tables, f)
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For a function of whole texts: a table of fewer input splits than the session has cores is dealt out
    to all of them; a larger one stays as it is read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(2 * cores)


#: Queries whose expressions cost far more than moving their rows: small tables are dealt out to all cores.
COSTLY = {"content_match_whole", "pii_spans_by_pattern", "not_secret_rules", "opaque_tokens", "opaque_tokens_made", "assignments", "string_measures", "entropy_per_doc", "content_allowlist_context"}


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    tables, f = SQL[name]
    if name in STAGED:
        steps, last = STAGED[name](SPARK, **{t: t for t in tables})
        return lambda spark, sf_dir: staged(spark, steps, last, ("made_samples", *passes.CUTS), **{t: read(spark, sf_dir, t) for t in tables})
    given = spread if name in COSTLY else lambda df: df
    if name in MATCHED:
        patterns, parts = MATCHED[name]
        return lambda spark, sf_dir: matched(spark, *parts(SPARK, **{t: t for t in tables}), patterns(), **{t: given(read(spark, sf_dir, t)) for t in tables})
    return lambda spark, sf_dir: over(spark, lambda **v: f(SPARK, **v), **{t: given(read(spark, sf_dir, t)) for t in tables})


#: Queries that match patterns over whole tables: (patterns, (steps, last statement) by dialect)
MATCHED: dict[str, tuple[Callable, Callable]] = {}


def matched(spark: SparkSession, steps: list[tuple[str, str]], last: str, patterns, **tables: DataFrame) -> DataFrame:
    """``chain(steps, last)`` of steps with ``engines.by_content``, the matching of values done a batch at a time. The steps refer to ``tables`` by their names."""

    def run(text: str, **held: DataFrame) -> DataFrame:
        return over(spark, lambda **v: chain([(k, f"SELECT * FROM {x}") for k, x in v.items()] + [s for s in steps if s[0] not in v], text), **tables, **held)

    return run(last, ch=matches.with_hits(run(engines.searched_values(SPARK)), patterns))


def over_whole(name: str, patterns: Callable):
    """Registers ``parts(q, **tables) -> (steps, last statement)`` with patterns matched over all values."""

    def keep(parts):
        MATCHED[name] = (patterns, parts)
        SQL[name] = (MADE_TABLES, lambda q, **t: chain(*parts(q, **t)))
        return parts

    return keep


#: Columns that are sums of integers, which one dialect has as 64 bits and the other as 128.
SUMS: dict[str, list[str]] = {}


def oracle(name: str) -> str:
    tables, f = SQL[name]
    text = f(DUCK, **{t: t for t in tables})
    if name in SUMS:
        return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in SUMS[name])}) FROM ({text}) AS sums_"
    return text


PLAIN = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"],
    "documents": ["doc_id", "lang", "source", "n_chars"],
}


def _rep(n: str, mul: int, mod: int, width: int) -> str:
    return f"lpad(CAST(({n} * {mul}) % {mod} AS STRING), {width}, '0')"


#: column name -> (table, key, value made from the key), so that rare formats occur at every scale
MADE = {
    "employee_ssn": ("orders", "o_orderkey", lambda n: f"concat({_rep(n, 7919, 899, 3)}, '-', {_rep(n, 31, 99, 2)}, '-', {_rep(n, 104729, 9999, 4)})"),
    "email_address": ("customer", "c_custkey", lambda n: f"concat('user', CAST({n} AS STRING), '@mail', CAST({n} % 7 AS STRING), '.org')"),
    "work_phone": ("customer", "c_custkey", lambda n: f"concat('(', {_rep(n, 37, 700, 3)}, ') 555-', {_rep(n, 7919, 9999, 4)})"),
    "client_ip": ("orders", "o_orderkey", lambda n: f"concat(CAST(11 + {n} % 90 AS STRING), '.', CAST({n} % 251 AS STRING), '.', CAST({n} * 7 % 253 AS STRING), '.9')"),
    "card": ("orders", "o_orderkey", lambda n: f"concat('4', {_rep(n, 104729, 99999999, 15)})"),
    "routing": ("supplier", "s_suppkey", lambda n: _rep(n, 7, 5, 9)),
    "tax_digits": ("orders", "o_orderkey", lambda n: f"concat('4', {_rep(n, 7919, 99999999, 8)})"),
    "npi": ("customer", "c_custkey", lambda n: f"concat('1', {_rep(n, 7919, 999999999, 9)})"),
    "api_token": ("customer", "c_custkey", lambda n: f"concat('ghp_', substr(md5(CAST({n} AS STRING)), 1, 32), 'AbCd')"),
    "session_blob": ("customer", "c_custkey", lambda n: f"concat(upper(substr(md5(CAST({n} AS STRING)), 1, 20)), 'xYz_', substr(md5(CAST({n} + 1 AS STRING)), 1, 20), 'Qw-Rt')"),
    "birth_date": ("orders", "o_orderkey", lambda n: f"concat(CAST(1950 + {n} % 50 AS STRING), '-0', CAST(1 + {n} % 9 AS STRING), '-1', CAST({n} % 10 AS STRING))"),
    "notes": ("orders", "o_orderkey", lambda n: f"concat('the public service invoice number ', CAST({n} AS STRING), ' is possible to provide without influence')"),
    "settings": ("supplier", "s_suppkey", lambda n: f"concat('db_password = \"', substr(md5(CAST({n} AS STRING)), 1, 9), 'Zq!7\"')"),
    "home_page": ("supplier", "s_suppkey", lambda n: f"concat('https://site', CAST({n} AS STRING), '.example.org/10.0.0.', CAST({n} % 200 AS STRING))"),
    "vehicle": ("part", "p_partkey", lambda n: f"concat('1HGCM', upper(substr(md5(CAST({n} AS STRING)), 1, 1)), '26', {_rep(n, 7919, 999999999, 9)})"),
    "mbi_number": ("part", "p_partkey", lambda n: f"concat('1EG4-TE5-MK', {_rep(n, 7, 99, 2)})"),
}


def _text(q: Dialect, s: str) -> str:
    return s if q.spark else s.replace("AS STRING", "AS VARCHAR")


def made_columns(q: Dialect) -> str:
    rows = [("staff", f"made.{n}", n, "employees", "STRING") for n in MADE]
    return f"SELECT * FROM {q.values(rows, ['group_id', 'column_id', 'column_name', 'table_name', 'data_type'])}"


def made_values(q: Dialect, t: dict[str, str]) -> str:
    if q.spark:  # a table is read once for all its columns
        of = lambda table: [f"'made.{c}', {f(k)}" for c, (at, k, f) in MADE.items() if at == table]
        return " UNION ALL ".join(f"SELECT stack({len(of(n))}, {', '.join(of(n))}) AS (column_id, value) FROM {t[n]}" for n in MADE_TABLES)
    return _text(q, " UNION ALL ".join(f"SELECT 'made.{c}' AS column_id, {f(k)} AS value FROM {t[table]}" for c, (table, k, f) in MADE.items()))


MADE_TABLES = ("customer", "orders", "part", "supplier")


def _made(q: Dialect, t: dict[str, str]) -> list[tuple[str, str]]:
    return [("made_columns", made_columns(q)), ("made_values", made_values(q, t)), ("made_samples", sample_sql(q, "made_values"))]


# -- sources ------------------------------------------------------------------------------------------
@sql("column_samples", *PLAIN)
def _(q, **t):
    """The sample of every column: 100 values of least md5."""
    long = " UNION ALL ".join(f"SELECT * FROM ({long_sql(q, n, t[n], cs)}) AS l_{n}" for n, cs in PLAIN.items())
    return chain([("long", long)], sample_sql(q, "long"))


@sql("user_prompts", "conversations")
def _(q, conversations):
    """Non-blank user turns with a stable id."""
    sha = "sha2({}, 256)" if q.spark else "sha256({})"
    return _text(q, f"SELECT substr({sha.format('concat(CAST(conv_id AS STRING), %s, CAST(turn AS STRING))' % q.text(':'))}, 1, 16) AS prompt_id, conv_id, turn, text FROM {conversations} WHERE role = 'user' AND trim(text) <> ''")


@sql("resume_anti_join", "conversations")
def _(q, conversations):
    """Turns that are still to be handled: those of conversations that have no answer yet past them."""
    done = f"SELECT conv_id, max(turn) AS upto FROM {conversations} WHERE role = 'assistant' GROUP BY conv_id"
    return f"SELECT c.conv_id, c.turn, c.role FROM {conversations} c {'LEFT ANTI' if q.spark else 'ANTI'} JOIN ({done}) d ON c.conv_id = d.conv_id AND c.turn <= d.upto"


@sql("stable_subsample", "documents")
def _(q, documents):
    """The 60 texts of least SHA-1 for each source."""
    return f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha1(text), doc_id) AS r FROM {documents} WHERE text IS NOT NULL) s_ WHERE r <= 60"


@sql("negative_reservoir", "documents")
def _(q, documents):
    """A fixed sample of 25 documents without an assignment of a secret."""
    return f"SELECT doc_id, md5(text) AS h FROM {documents} WHERE NOT {q.like('text', '(?i)(token|secret|password)\\s*=')} ORDER BY md5(text), doc_id LIMIT 25"


# -- validators and string functions ------------------------------------------------------------------
_SHAPES = {
    "luhn": lambda n: f"concat('4', {_rep(n, 104729, 999999999, 15)})", "luhn_strip": lambda n: f"concat('4111-1111-', {_rep(n, 31, 9999, 4)}, ' ', {_rep(n, 7919, 9999, 4)})", "npi_luhn": lambda n: f"concat('1', {_rep(n, 7919, 999999999, 9)})", "sin_luhn": lambda n: _rep(n, 7919, 999999999, 9),
    "ssn_zeros": lambda n: f"concat({_rep(n, 331, 1000, 3)}, '-', {_rep(n, 7, 12, 2)}, '-', {_rep(n, 13, 5000, 4)})", "ipv4_not_reserved": lambda n: f"concat(CAST({n} % 260 AS STRING), '.', CAST({n} * 7 % 260 AS STRING), '.', CAST({n} * 3 % 256 AS STRING), '.1')", "dea_checkdigit": lambda n: f"concat('AB', {_rep(n, 7919, 9999999, 7)})",
    "vin_checkdigit": lambda n: f"concat('1HGCM', upper(substr(md5(CAST({n} AS STRING)), 1, 1)), '26', {_rep(n, 7919, 999999999, 9)})", "ein_prefix": lambda n: f"concat({_rep(n, 7, 100, 2)}, '-', {_rep(n, 7919, 9999999, 7)})", "aba_checksum": lambda n: _rep(n, 7919, 999999999, 9), "iban_checksum": lambda n: f"concat('DE', {_rep(n, 7, 100, 2)}, ' 3704 0044 0532 0130 ', {_rep(n, 3, 100, 2)})",
    "phone_number": lambda n: f"concat('+1 415 ', {_rep(n, 7, 1000, 3)}, '-', {_rep(n, 31, 9999, 4)}, CASE WHEN {n} % 3 = 0 THEN ' ext 12' ELSE '' END)", "aws_secret_not_hex": lambda n: f"concat(CASE WHEN {n} % 2 = 0 THEN 'Zz' ELSE '' END, md5(CAST({n} AS STRING)))", "random_password": lambda n: f"concat(CASE WHEN {n} % 2 = 0 THEN 'Ab!' ELSE 'ab' END, CAST({n} AS STRING))",
    "ethereum_address": lambda n: f"concat('0x', md5(CAST({n} AS STRING)), CASE WHEN {n} % 2 = 0 THEN '12abCD34' ELSE '12abCD3' END)", "not_placeholder_credential": lambda n: f"CASE {n} % 5 WHEN 0 THEN 'changeme' WHEN 1 THEN 'aXXXXXXb' WHEN 2 THEN '1111111111z' WHEN 3 THEN 'your_key' ELSE md5(CAST({n} AS STRING)) END",
    "swift_bic_country_code": lambda n: f"concat('ABCD', substr('DEFRZZUSQQ', CAST(1 + 2 * ({n} % 5) AS INT), 2), {_rep(n, 7, 100, 2)})", "openai_legacy_key": lambda n: f"concat('sk-', CASE WHEN {n} % 2 = 0 THEN 'abcdef' ELSE md5(CAST({n} AS STRING)) END)", "huggingface_token": lambda n: f"concat('hf_', CASE WHEN {n} % 2 = 0 THEN 'camelCaseWord_x' ELSE md5(CAST({n} AS STRING)) END)",
    "bulgarian_egn": lambda n: _rep(n, 104729, 9999999999, 10), "czech_rodne_cislo": lambda n: f"concat({_rep(n, 3, 100, 2)}, {_rep(n, 7, 13, 2)}, {_rep(n, 11, 32, 2)}, '/', {_rep(n, 7919, 9999, 4)})", "swiss_ahv": lambda n: f"concat('756.', {_rep(n, 7, 9999, 4)}, '.', {_rep(n, 31, 9999, 4)}, '.', {_rep(n, 3, 99, 2)})", "danish_cpr": lambda n: f"concat({_rep(n, 7, 32, 2)}, {_rep(n, 5, 13, 2)}, {_rep(n, 3, 99, 2)}, '-', {_rep(n, 7919, 9999, 4)})",
    "german_steuerid": lambda n: f"concat('1', {_rep(n, 104729, 9999999999, 10)})", "french_nir": lambda n: f"concat('1', {_rep(n, 104729, 999999999999, 12)}, {_rep(n, 7, 98, 2)})", "spanish_dni": lambda n: f"concat({_rep(n, 7919, 99999999, 8)}, substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(1 + {n} % 23 AS INT), 1))", "spanish_nie": lambda n: f"concat('X', {_rep(n, 7919, 9999999, 7)}, substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(1 + {n} % 23 AS INT), 1))",
    "italian_codice_fiscale": lambda n: f"concat('RSSMRA', {_rep(n, 7, 99, 2)}, 'A01H', {_rep(n, 7919, 999, 3)}, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(1 + {n} % 26 AS INT), 1))", "dutch_bsn": lambda n: f"concat('1', {_rep(n, 7919, 99999999, 8)})", "austrian_svnr": lambda n: f"concat('1', {_rep(n, 104729, 999999999, 9)})",
}


def _validator(name):
    @sql(f"validator_{name}", "orders")
    def _(q, orders, name=name):
        v = f"SELECT o_orderkey, {_SHAPES[name]('o_orderkey')} AS value FROM {orders}"
        return _text(q, f"SELECT o_orderkey, value, {validators.sql(q, name, 'value')} AS valid FROM ({v}) v_")


for _n in _SHAPES:
    _validator(_n)


@sql("string_measures", "conversations")
def _(q, conversations):
    return f"SELECT conv_id, turn, round({T.entropy(q, 'text')}, 6) AS entropy, {T.charset(q, 'text')} AS charset, round({T.relative_entropy(q, 'text')}, 6) AS relative, {T.diversity(q, 'text')} AS diversity, round({T.evenness(q, 'text')}, 6) AS evenness FROM {conversations} WHERE text IS NOT NULL"


@sql("entropy_per_doc", "documents")
def _(q, documents):
    return f"SELECT doc_id, round({T.entropy(q, 'text')}, 6) AS entropy FROM {documents} WHERE text IS NOT NULL"


@sql("masked_values", "customer")
def _(q, customer):
    kinds = ["SSN", "EMAIL", "PHONE", "CREDIT_CARD", "PERSON_NAME"]
    values = " UNION ALL ".join(f"SELECT c_custkey, '{k}' AS entity_type, CASE WHEN '{k}' = 'EMAIL' THEN concat(lower(c_mktsegment), '@x.org') ELSE c_name END AS value FROM {customer}" for k in kinds)
    return f"SELECT c_custkey, entity_type, {T.mask(q, 'value', 'entity_type')} AS masked, {T.mask_text(q, 'value')} AS masked_text FROM ({values}) v_"


@sql("name_normalisation", "customer")
def _(q, customer):
    name = "concat('customer', substr('HomeEMailSSNNumberXMLKey', CAST(1 + c_custkey % 9 AS INT), 9), '-Id_', c_mktsegment, ' Value')"
    return f"SELECT c_custkey, {T.normalised(q, 'v')} AS normalised, {T.camel_to_snake(q, 'v')} AS snake FROM (SELECT c_custkey, {name} AS v FROM {customer}) n_"


def _tokens(q, documents):
    return f"SELECT doc_id, token FROM (SELECT doc_id, {q.explode(q.split('text', r'\s+'))} AS token FROM {documents}) t_ WHERE length(token) >= 8"


@sql("not_secret_rules", "documents")
def _(q, documents):
    """How many tokens each rule of "obviously no secret" holds for."""
    flags = lambda n: ", ".join(f"sum({n}CAST({test} AS INT)) AS {name}" for name, test in [*((x, T.not_secret_rule(q, x, "token")) for x in T.NOT_SECRET), ("placeholder", T.placeholder(q, "token"))])
    if q.spark:  # the rules are tried once for each distinct token
        return chain([("t", _tokens(q, documents)), ("d", "SELECT token, count(*) AS n FROM t GROUP BY token")], f"SELECT coalesce(sum(n), 0) AS tokens, {flags('n * ')} FROM d")
    return chain([("t", _tokens(q, documents))], f"SELECT count(*) AS tokens, {flags('')} FROM t")


SUMS["not_secret_rules"] = [*T.NOT_SECRET, "placeholder"]


@sql("opaque_tokens", "documents")
def _(q, documents):
    """Bare tokens that look like secrets."""
    bare = q.replace("token", r"""^["'`]+|["'`,.;:!?)\]}]+$""")
    steps = [("t", _tokens(q, documents)), ("b", f"SELECT doc_id, {bare} AS token FROM t"), ("d", "SELECT doc_id, token, count(*) AS n FROM b WHERE length(token) >= 16 GROUP BY doc_id, token"), ("m", f"SELECT *, {T.measures(q, 'token')} FROM d"), ("s", f"SELECT *, {q.once(T.opaque_confidence(q, 'token'))} AS conf FROM m")]
    return chain(steps, f"SELECT doc_id, {T.mask_text(q, 'token')} AS masked, n, round(conf, 4) AS confidence FROM s WHERE conf > 0")


@sql("key_scores", "orders")
def _(q, orders):
    """Scores of key names, and of values under them."""
    names = ["apiKey", "db_password", "token", "sessionKey", "user_name", "signature", "token_address", "clientSecret", "pwd", "xai_value", "auth_id"]
    key = f"CASE o_orderkey % {len(names)} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"
    value = "CASE o_orderkey % 3 WHEN 0 THEN concat('Ab_', md5(CAST(o_orderkey AS STRING))) WHEN 1 THEN md5(CAST(o_orderkey AS STRING)) ELSE 'plain words here' END"
    steps = [("k", f"SELECT o_orderkey, {key} AS name, {value} AS value FROM {orders}"), ("s", f"SELECT *, {T.key_score(q, 'name')} AS best, {T.compound_key(q, 'name')} AS compound FROM k")]
    score, tier = q.double(f"{q.split('best', '[|]')}[{0 if q.spark else 1}]"), f"{q.split('best', '[|]')}[{1 if q.spark else 2}]"
    return _text(q, chain([*steps, ("p", f"SELECT *, {score} AS score, {tier} AS tier, {T.measures(q, 'value')} FROM s")], f"SELECT o_orderkey, name, best, compound, round({T.tiered_score('score', 'tier')}, 4) AS composite FROM p"))


# -- aggregates, engines and passes -------------------------------------------------------------------
def _register_profiles():
    for table in PLAIN:
        def build(q, _table=table, **t):
            return chain([("long", long_sql(q, _table, t[_table], PLAIN[_table])), *profile.profile_steps(q, "long")], profile.rounded())

        SQL[f"column_profile_{table}"] = ((table,), build)


_register_profiles()


def _names_of(q, t):
    rows = [("all", f"{n}.{c}", c, n, "STRING") for n, cs in PLAIN.items() for c in cs]
    rows += [("all", f"x.{k}", n, "patients", "STRING") for k, n in enumerate("PatientSSN cust_addr homeEmail cc_num ssn creditCardNumber MedicalRecordNo BirthDate zipCode wallet_btc_addr random total ip api-key Password user_fname".split())]
    return q.values(rows, ["group_id", "column_id", "column_name", "table_name", "data_type"])


@sql("column_name_match")
def _(q):
    return chain([("columns_", f"SELECT * FROM {_names_of(q, {})}"), *engines.by_name(q, "columns_")], "SELECT column_id, entity_type, category, sensitivity, round(confidence, 6) AS confidence FROM by_name")


@sql("profile_rule_match")
def _(q):
    return chain([("columns_", f"SELECT * FROM {_names_of(q, {})}"), *engines.by_profile_rule(q, "columns_")], f"SELECT column_id, entity_type, confidence, {q.size('regulatory')} AS regulations FROM by_rule")


@sql("content_match", *MADE_TABLES)
def _(q, **t):
    """Content patterns over the samples: matches, validation, ratio and evidence."""
    return chain([*_made(q, t), *engines.by_content(q, "made_columns", "made_samples")], "SELECT column_id, detection_type, entity_type, round(confidence, 6) AS confidence, matched, validated, round(CAST(matched AS DOUBLE) / scanned, 6) AS match_ratio, matches[{}] AS first_match FROM by_content".format(0 if q.spark else 1))


@over_whole("content_match_whole", content_patterns)
def _(q, **t):
    """The same over all values of the columns, no sample."""
    steps = [("made_columns", made_columns(q)), ("made_values", made_values(q, t)), ("all_values", "SELECT column_id, CAST(0 AS BIGINT) AS pos, value FROM made_values"), *engines.by_content(q, "made_columns", "all_values", evidence=False)]
    return steps, "SELECT column_id, detection_type, entity_type, round(confidence, 6) AS confidence, matched, validated, scanned FROM by_content"


_OWN_RULES = (("LOYALTY_ID", "PII", "LOW", 0.6, ("GDPR",), (r"(?:^|_)(?:loyalty|club|member)(?:_|$)",)), ("CUSTOMER_NAME", "PII", "MEDIUM", 0.7, ("GDPR", "CCPA"), (r"^c_name$", r"cust.*name")), ("ANY_NAME", "PII", "LOW", 0.55, ("GDPR",), ("name$",)))


@sql("custom_profile_match")
def _(q):
    """Column names under a profile of one's own; the first rule wins."""
    rows = [("all", f"y.{k}", n, "shop", "STRING") for k, n in enumerate("club_id member_no c_name customer_full_name p_name total Loyalty_Card".split())]
    columns = f"(SELECT * FROM {_names_of(q, {})} UNION ALL SELECT * FROM {q.values(rows, ['group_id', 'column_id', 'column_name', 'table_name', 'data_type'])})"
    return chain([("columns_", f"SELECT * FROM {columns} AS c_"), *engines.by_profile_rule(q, "columns_", _OWN_RULES)], f"SELECT column_id, entity_type, sensitivity, confidence, {q.size('regulatory')} AS regulations FROM by_rule")


def _own_patterns():
    base = {p.name: p for p in content_patterns()}
    return (
        base["email_address"]._replace(allow=("@mail[03][.]org$",), stop=("user1@mail1.org", "USER8@MAIL1.ORG")),
        base["ipv4_address"]._replace(allow=(r"^1[0-9][.]", r"[.]7[.][0-9]+$")),
        base["email_address"]._replace(name="noted_number", entity_type="NOTED", regex="[0-9]{2,}", validator="", boost=("invoice",), suppress=("public",)),
        base["email_address"]._replace(name="doubted_number", entity_type="DOUBTED", regex="number [0-9]+", validator="", boost=("nowhere",), suppress=("Public", "private")),
    )


@over_whole("content_allowlist_context", _own_patterns)
def _(q, **t):
    """Patterns with known false positives, placeholders of their own, and words that move their confidence, over all values."""
    steps = [("made_columns", made_columns(q)), ("made_values", made_values(q, t)), ("all_values", "SELECT column_id, CAST(0 AS BIGINT) AS pos, value FROM made_values"), *engines.by_content(q, "made_columns", "all_values", _own_patterns(), evidence=False)]
    return steps, "SELECT column_id, detection_type, entity_type, round(confidence, 6) AS confidence, matched, validated, scanned FROM by_content"


@sql("trace_lines", "orders")
def _(q, orders):
    """Which lines of logs belong to stack traces, so that their names are no keys."""
    forms = ["Traceback (most recent call last):", 'File "/srv/app{}.py", line 12, in token', "  raise ValueError(token)", "at com.shop.Auth{}.login(Auth.java:5)", "in load_{}(secret, password)", "KeyError: 'password{}'", "TimeoutException: token={}", "goroutine 1{} [running]:", "panic: secret={}", "Cell In[3], line {}", "password = hunter{}", "token: {}", "error in {}", "attach(secret{})", "Raised {}"]
    line = f"CASE o_orderkey % {len(forms)} " + " ".join(f"WHEN {k} THEN replace({q.text(f)}, '{{}}', CAST(o_orderkey % 97 AS STRING))" for k, f in enumerate(forms)) + " END"
    return _text(q, f"SELECT o_orderkey, line, {T.trace_line(q, 'line')} AS trace FROM (SELECT o_orderkey, {line} AS line FROM {orders}) l_")


@sql("heuristic_ssn_aba", *MADE_TABLES)
def _(q, **t):
    return chain([*_made(q, t), *profile.profile_steps(q, "made_samples"), *engines.by_statistics(q)], "SELECT column_id, entity_type, round(confidence, 4) AS confidence FROM by_stats")


@sql("secret_columns", *MADE_TABLES)
def _(q, **t):
    return chain([*_made(q, t), *engines.by_secret(q, "made_columns", "made_samples")], "SELECT column_id, entity_type, confidence, matched, scanned FROM by_secret")


@sql("opaque_columns", *MADE_TABLES)
def _(q, **t):
    return chain([*_made(q, t), *profile.profile_steps(q, "made_samples"), *engines.by_entropy(q)], "SELECT column_id, entity_type, round(confidence, 3) AS confidence, matched, scanned FROM by_entropy")


#: Queries whose statement is run in stages on the engine: (steps, last statement) by dialect
STAGED: dict[str, Callable] = {}


def classified(name: str, **options):
    """Registers ``last(q) -> (more steps, last statement)`` after the whole chain of engines and passes."""

    def keep(last):
        def parts(q, **t):
            more, final = last(q)
            return _made(q, t) + C.raw_steps(q, "made_columns", "made_samples") + passes.steps(q, "raw", "made_columns", **options) + more, final

        STAGED[name] = parts
        SQL[name] = (MADE_TABLES, lambda q, **t: chain(*parts(q, **t)))
        return last

    return keep


@classified("classify_columns")
def _(q):
    """Engines, passes and ranking from end to end."""
    return [], f"SELECT column_id, entity_type, category, sensitivity, round(confidence, 6) AS confidence, engine, family, place FROM ({passes.ranked(q, 'final')}) r_"


@classified("classify_top1_financial", categories=["Financial", "Health"])
def _(q):
    return [], f"SELECT column_id, entity_type, round(confidence, 6) AS confidence FROM ({passes.ranked(q, 'final', 1)}) r_"


@classified("column_shapes")
def _(q):
    return [], "SELECT * FROM shape"


@classified("tier_gate")
def _(q):
    return [], passes.gate(q, "f18", "f2")


def _rolled(q, source: str) -> str:
    join = (lambda a: f"array_join({a}, ',')") if q.spark else (lambda a: f"array_to_string({a}, ',')")
    return f"SELECT parent, sensitivity, {join('classifications')} AS classifications, {join('frameworks')} AS frameworks, findings_count FROM {source}"


def _rollups(q):
    return [("parents", "SELECT column_id, CASE WHEN column_id < 'made.h' THEN 'first' ELSE 'second' END AS parent FROM made_columns"), ("tables_", rollup.rollup_sql(q, "final", "parents"))]


@classified("rollup_table")
def _(q):
    return _rollups(q), _rolled(q, "tables_")


@classified("rollup_dataset")
def _(q):
    return [*_rollups(q), ("datasets", "SELECT DISTINCT parent AS child, 'all' AS parent FROM parents"), ("top_", rollup.again_sql(q, "tables_", "datasets"))], _rolled(q, "top_")


def _random_findings(q, events):
    """Findings made from events, many for each column, for the passes alone."""
    kinds = "SSN ABA_ROUTING CANADIAN_SIN NPI PHONE DEA_NUMBER IBAN CREDENTIAL API_KEY EMAIL PERSON_NAME ADDRESS IP_ADDRESS DATE_OF_BIRTH CREDIT_CARD".split()
    engs = [("column_name", 10), ("regex", 5), ("heuristic_stats", 1), ("secret_scanner", 1), ("model", 1)]
    kind = f"CASE h % {len(kinds)} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " END"
    eng = "CASE h % 5 " + " ".join(f"WHEN {i} THEN '{e}'" for i, (e, _) in enumerate(engs)) + " END"
    auth = "CASE h % 5 " + " ".join(f"WHEN {i} THEN {a}" for i, (_, a) in enumerate(engs)) + " END"
    cat = case(kind, {k: "Credential" for k in ("CREDENTIAL", "API_KEY")}, "'PII'")
    return _text(q, f"""SELECT concat('c', CAST(event_id % 1999 AS STRING)) AS column_id, {kind} AS entity_type, {cat} AS category, CASE h % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS sensitivity, CAST(50 + (h * 7) % 50 AS DOUBLE) / 100 AS confidence, {q.texts(['GDPR'])} AS regulatory, {eng} AS engine, {auth} AS authority, CAST(event_id AS INT) AS seq,
CASE WHEN h % 3 = 0 THEN 'p' ELSE '' END AS detection_type, CAST(h % 20 AS BIGINT) AS matched, CAST(floor(h % 20 * (h % 7) / 7.0) AS BIGINT) AS validated, CAST(20 AS BIGINT) AS scanned, {q.array(["CASE WHEN h % 4 = 0 THEN 'http://10.1.1.1/a' ELSE 'changeme' END"])} AS matches FROM (SELECT event_id, (event_id * 7919 + user_id) % 1000003 AS h FROM {events}) e_""")


def _pass(name, build):
    @sql(f"pass_{name}", "events")
    def _(q, events):
        steps = [("given", _random_findings(q, events)), ("cols", "SELECT DISTINCT concat('g', substr(column_id, 2, 2)) AS group_id, column_id, CASE WHEN column_id LIKE '%7' THEN 'Mobile No' ELSE 'x' END AS column_name FROM given"), ("none_", "SELECT column_id FROM given WHERE column_id LIKE '%99'"), ("out_", build(q))]
        return chain(steps, "SELECT column_id, entity_type, engine, seq, round(confidence, 6) AS confidence FROM out_")


_pass("calibrate", lambda q: passes.calibrated(q, "given"))
_pass("merge_authority", lambda q: passes.merged(q, "given"))
_pass("weighting", lambda q: passes.weighted(q, "given", "given", "(SELECT DISTINCT column_id FROM none_)"))
_pass("model_only", lambda q: passes.model_only(q, "given", "given", "(SELECT DISTINCT column_id FROM none_)"))
for _a, _b in passes.COLLISIONS:
    _pass(f"collision_{_a}_{_b}".lower(), lambda q, a=_a, b=_b: passes.collision(q, "given", a, b))
_pass("phone", lambda q: passes.phone(q, "given", "cols"))
_pass("generic_credential", lambda q: passes.generic(q, "given"))
_pass("in_urls", lambda q: passes.in_urls(q, "given"))
_pass("credential_noise", lambda q: passes.noise(q, "given"))
def _model_says(q, of: str) -> str:
    kinds = "SSN EMAIL NEGATIVE PASSPORT PHONE API_KEY UNHEARD_OF".split()
    h = "CAST(substr(column_id, 2) AS INT)" if q.spark else "CAST(substr(column_id, 2) AS INTEGER)"
    kind = f"CASE {h} % {len(kinds)} " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(kinds)) + " END"
    return f"(SELECT column_id, {kind} AS entity_type, CAST(40 + {h} % 60 AS DOUBLE) / 100 AS confidence FROM (SELECT DISTINCT column_id FROM {of}) k_)"


def _spans_say(q) -> str:
    given = {"entity_type": "CASE WHEN e.seq % 2 = 0 THEN 'EMAIL' ELSE 'SSN' END", "engine": "'model'", "confidence": "e.confidence - 0.02"}
    cols = ", ".join(f"{given.get(c, f'e.{c}')} AS {c}" for c in engines.FIELDS)
    return f"(SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY column_id ORDER BY seq) AS k_ FROM given) e WHERE k_ = 1)"


_pass("per_value_union", lambda q: passes.united(q, "given", _spans_say(q), "(SELECT DISTINCT column_id, CASE WHEN column_id LIKE '%3' THEN 'opaque_tokens' ELSE 'free_text_heterogeneous' END AS shape FROM given)"))
_pass("second_stage", lambda q: passes.directive(q, "given", _model_says(q, "given")))
_pass("siblings", lambda q: passes.siblings(q, "given", "cols", 0.5))
_pass("gap", lambda q: passes.ranked(q, "given", gap=0.2))
_pass("gap_aggressive", lambda q: passes.ranked(q, "given", aggressive=True))
_pass("top3", lambda q: passes.ranked(q, "given", 3))


@sql("families", "events")
def _(q, events):
    return chain([("given", _random_findings(q, events))], f"SELECT {case('entity_type', FAMILY, 'entity_type')} AS family, count(*) AS n, round(avg(confidence), 6) AS mean FROM given GROUP BY 1")


#: name -> function, for what SQL of both dialects cannot say
FRAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL of those that only one dialect can say
ORACLES: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import text_queries  # noqa: F401  registers itself

    return {n: run(n) for n in SQL} | FRAMES


def oracle_sql() -> dict[str, str]:
    from . import text_queries  # noqa: F401

    return {n: oracle(n) for n in SQL} | ORACLES
