"""Queries over text, metrics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import validators
from ..functions.dialect import DUCK, SPARK
from ..model import FAMILY, case
from ..operators import engines, metrics, passes, spans, structured, zones
from ..patterns import content_patterns
from ..sources import prompts
from ..streaming import jobs
from .catalogue import FRAMES, ORACLES, SUMS, _random_findings, _text, read, spread, sql
from .sql import chain

_BY_NAME = {p.name: p for p in content_patterns()}


#: Patterns counted over whole texts; those that only hold in columns of a certain name have no place there
_COUNTED = [p for p in content_patterns() if p.category != "Credential" and not p.hints]
SUMS |= {f"scan_{n}": ["valid"] for n in ("email", "ipv4", "card", "phone", "url")}
SUMS |= {"pii_spans_by_pattern": [p.name for p in _COUNTED], "zone_line_measures": ["blank", "listed", "commas"], "confidence_buckets": ["high", "mid", "low"], "label_set_metrics": ["exact", "hit", "missed", "extra", "all_missed"], "session_counts": ["sessions"]}


def _scan(name, pattern, table, key, column):
    p = _BY_NAME[pattern] if isinstance(pattern, str) else pattern

    @sql(name, table)
    def _(q, **t):
        found = f"SELECT {key}, {q.explode(q.all(column, p.regex, 0))} AS value FROM {t[table]}"
        valid = validators.VALIDATORS[p.validator](q, "value") if p.validator else "true"
        return f"SELECT {key}, count(*) AS matches, sum(CASE WHEN {valid} THEN 1 ELSE 0 END) AS valid, min({T.mask(q, 'value', q.text(p.entity_type))}) AS masked FROM ({found}) f_ GROUP BY {key}"


_scan("scan_email", "email_address", "documents", "doc_id", "text")
_scan("scan_ipv4", "ipv4_address", "documents", "doc_id", "text")
_scan("scan_card", _BY_NAME["credit_card_formatted"]._replace(regex="%b[0-9](?:[- ]?[0-9]){12,18}%b"), "documents", "doc_id", "text")
_scan("scan_phone", "us_phone_formatted", "documents", "doc_id", "text")
_scan("scan_url", "url", "pages", "page_id", "html")


@sql("scan_url_made", "supplier")
def _(q, supplier):
    """The same over values that hold addresses of pages: the given tables have few."""
    p = _BY_NAME["url"]
    value = "concat('see https://site', CAST(s_suppkey AS STRING), '.example.org/a?b=', CAST(s_suppkey % 7 AS STRING), ' and ftp:// or http://x', CAST(s_suppkey % 5 AS STRING), '.net')"
    found = f"SELECT s_suppkey, {q.explode(q.all('value', p.regex, 0))} AS value FROM (SELECT s_suppkey, {value} AS value FROM {supplier}) v_"
    return _text(q, f"SELECT s_suppkey, count(*) AS matches, min(value) AS first_url FROM ({found}) f_ GROUP BY s_suppkey")


@sql("opaque_tokens_made", "customer")
def _(q, customer):
    """Bare tokens made from keys: random ones, hexadecimal ones, names and identifiers."""
    forms = ["concat(upper(substr(md5(CAST(c_custkey AS STRING)), 1, 12)), 'xYz_', substr(md5(CAST(c_custkey + 1 AS STRING)), 1, 14), 'Qw-Rt')", "md5(CAST(c_custkey AS STRING))", "concat('com.example.module.name', CAST(c_custkey AS STRING))", "concat('aB3', substr(md5(CAST(c_custkey AS STRING)), 1, 20), 'Zq')", "concat('test_', md5(CAST(c_custkey AS STRING)), 'AbC-')", "'aaaaaaaaaaaaaaaaaaaaaaaa'"]
    token = f"CASE c_custkey % {len(forms)} " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(forms)) + " END"
    steps = [("b", f"SELECT c_custkey, {token} AS token FROM {customer}"), ("m", f"SELECT *, {T.measures(q, 'token')} FROM b"), ("s", f"SELECT *, {q.once(T.opaque_confidence(q, 'token'))} AS conf FROM m")]
    return _text(q, chain(steps, f"SELECT c_custkey, {T.mask_text(q, 'token')} AS masked, round(conf, 4) AS confidence FROM s WHERE conf > 0"))


@sql("pii_spans_by_pattern", "documents")
def _(q, documents):
    """Matches of every PII, health and financial pattern over the whole texts."""
    counts = ", ".join(f"sum(CASE WHEN {engines.screened(q, p.regex)} THEN {q.size(q.all('text', p.regex, 0))} ELSE 0 END) AS {p.name}" for p in _COUNTED)
    return f"SELECT source, {counts} FROM (SELECT source, text, {engines.screen_columns(q, 'text')} FROM {documents} WHERE text IS NOT NULL) d_ GROUP BY source"


@sql("assignments", "documents")
def _(q, documents):
    """Quoted assignments in texts, scored by key and value."""
    p = r"([A-Za-z_][A-Za-z0-9_]*)\s*(?::=|[:=])\s*\x22([^\x22\n]{8,500})\x22"
    steps = [
        ("m", f"SELECT doc_id, {q.explode(q.all('text', p, 0))} AS whole FROM {documents} WHERE text IS NOT NULL"),
        ("kv", f"SELECT doc_id, {q.first('whole', p, 1)} AS name, {q.first('whole', p, 2)} AS value FROM m"),
        ("k", f"SELECT *, {T.key_score(q, 'name')} AS best FROM kv WHERE NOT {T.anti_indicated(q, 'name', 'value')} AND NOT {T.compound_key(q, 'name')} AND NOT {T.placeholder(q, 'value')}"),
        ("s", f"SELECT *, {q.double(f'{q.split("best", "[|]")}[{0 if q.spark else 1}]')} AS score, {q.split('best', '[|]')}[{1 if q.spark else 2}] AS tier, {T.measures(q, 'value')} FROM k"),
    ]
    return chain(steps, f"SELECT doc_id, name, {T.mask_text(q, 'value')} AS masked, tier, round({T.tiered_score('score', 'tier')}, 4) AS confidence FROM s WHERE score > 0")


@sql("structural_secrets", "orders")
def _(q, orders):
    """Credentials in statements, headers, command lines and connection strings."""
    forms = ["CREATE USER bob IDENTIFIED BY 'S{}k'", "GRANT ALL ON x TO y IDENTIFIED BY \"p{}w\"", "SET PASSWORD FOR bob = PASSWORD('q{}z')", "mysql://root:a{}b@db.host/x", "Authorization: Bearer t{}", "Authorization: Basic QWxhZGRpbjpvcGVu", "X-API-Key: k{}kk", "Cookie: a=b; session_id=s{}", "tool --api-key=z{}z --token yy{}",
             "psql -p pw{}pw", "jdbc:mysql://h/db?user=a&password=j{}j", "Driver=x;Server=y;Pwd=o{}o", "redis://:r{}r@cache:6379", "postgres://u:p%40{}@host/db", "Server=a;Password=g{}g;", "password=<your-password>;x=1", "nothing to see here at all"]
    value = f"CASE o_orderkey % {len(forms)} " + " ".join(f"WHEN {k} THEN replace({q.text(f)}, '{{}}', substr(md5(CAST(o_orderkey AS STRING)), 1, 8))" for k, f in enumerate(forms)) + " END"
    steps = [("v", f"SELECT o_orderkey, {value} AS value FROM {orders}"), ("r", structured.rule_sql(q, "v", "o_orderkey", "value"))]
    return _text(q, chain(steps, "SELECT o_orderkey, rule, source, entity_type, confidence, credential FROM r"))


@sql("prescreen", "documents")
def _(q, documents):
    return f"SELECT doc_id, {zones.prescreen_sql(q, 'text')} AS passes FROM {documents} WHERE text IS NOT NULL"


@sql("zone_line_measures", "conversations")
def _(q, conversations):
    """Lines of texts with the measures that the zone steps start from."""
    lines = f"SELECT conv_id, turn, {q.explode('split(text, %s)' % q.text(chr(10)) if q.spark else 'string_split(text, chr(10))')} AS line FROM {conversations}"
    dense = f"CASE WHEN trim(line) = '' THEN 0.0 ELSE CAST(length({q.replace('line', r'[^{}()\[\];=<>|&!@#$^*/\\~]')}) AS DOUBLE) / length(trim(line)) END"
    return f"SELECT conv_id, turn, count(*) AS n_lines, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) AS blank, round(max({dense}), 6) AS density, sum(CASE WHEN {q.like('line', r'^\s*(\d+[.):]\s+|[-*]\s+)')} THEN 1 ELSE 0 END) AS listed, sum({q.size(q.all('line', ','))}) AS commas FROM ({lines}) l_ GROUP BY conv_id, turn"


def _labels(q, events):
    given = _random_findings(q, events)
    one = "SELECT column_id, entity_type FROM (SELECT column_id, entity_type, row_number() OVER (PARTITION BY column_id ORDER BY confidence {}, seq) AS r_ FROM given) a_ WHERE r_ = 1"
    return [("given", given), ("said_", one.format("DESC")), ("real_", one.format("ASC"))]


@sql("family_metrics", "events")
def _(q, events):
    return chain([*_labels(q, events), *metrics.family_steps(q, "said_", "real_")], "SELECT * FROM by_family")


@sql("overall_metrics", "events")
def _(q, events):
    return chain([*_labels(q, events), *metrics.family_steps(q, "said_", "real_")], "SELECT * FROM overall")


@sql("collision_matrix", "events")
def _(q, events):
    return chain([("given", _random_findings(q, events))], metrics.collision_matrix(q, "given"))


@sql("confidence_buckets", "events")
def _(q, events):
    return chain([("given", _random_findings(q, events))], metrics.confidence_buckets("given"))


@sql("comparator_agreement", "events")
def _(q, events):
    return chain([*_labels(q, events), ("o_", "SELECT * FROM said_ WHERE column_id NOT LIKE '%3'"), ("t_", "SELECT * FROM real_ WHERE column_id NOT LIKE '%5'")], metrics.agreement("o_", "t_"))


@sql("label_set_metrics", "events")
def _(q, events):
    return chain([("given", _random_findings(q, events)), ("p_", "SELECT DISTINCT column_id, entity_type FROM given WHERE confidence >= 0.6"), ("t_", "SELECT DISTINCT column_id, entity_type FROM given WHERE confidence >= 0.7")], metrics.label_sets("p_", "t_"))


@sql("benchmark_history", "events")
def _(q, events):
    """The eight latest days, as if each were a run."""
    day = f"SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM {events} GROUP BY 1"
    return chain([("h", day)], metrics.recent("h", "day", "n", 8))


@sql("table_profile", "events")
def _(q, events):
    steps = [("given", _random_findings(q, events)), ("cols", "SELECT DISTINCT concat('g', substr(column_id, 2, 3)) AS group_id, column_id FROM given")]
    return chain(steps, passes.table_profile(q, "given", "cols"))


@sql("classification_events", "events")
def _(q, events):
    return chain([("given", _random_findings(q, events))], passes.classification_events(q, "given", "run-1"))


@sql("context_words", "conversations")
def _(q, conversations):
    """What words beside a value would add to its confidence."""
    return f"SELECT conv_id, turn, CAST({T.context_adjustment(q, 'text', ['please', 'the', 'und'], ['test', 'la', 'der'])} AS DOUBLE) AS delta FROM {conversations} WHERE text IS NOT NULL"


@sql("feature_vectors", "events")
def _(q, events):
    """The numbers a second-stage model would see of a column's findings."""
    agg = "SELECT column_id, " + ", ".join(f"coalesce(max(CASE WHEN engine = '{e}' THEN confidence END), 0.0) AS {e}" for e in ("column_name", "regex", "heuristic_stats", "secret_scanner", "model"))
    fam = case("entity_type", FAMILY, "entity_type")
    return chain([("given", _random_findings(q, events)), ("r", "SELECT *, row_number() OVER (PARTITION BY column_id ORDER BY confidence DESC, seq) AS k FROM given")], f"{agg}, count(DISTINCT engine) AS engines, count(DISTINCT {fam}) AS families, max(CASE WHEN k = 1 THEN entity_type END) AS top, round(max(CASE WHEN k = 1 THEN confidence END) - coalesce(max(CASE WHEN k = 2 THEN confidence END), 0.0), 6) AS gap, round(max(CASE WHEN engine = 'regex' THEN CAST(matched AS DOUBLE) / scanned ELSE 0.0 END), 6) AS ratio FROM r GROUP BY column_id")


@sql("window_event_counts", "events")
def _(q, events):
    start = "window(ts, '5 minutes').start" if q.spark else "time_bucket(INTERVAL '5 minutes', ts)"
    return f"SELECT {start} AS start, event_type, count(*) AS n FROM {events} GROUP BY 1, 2"


@sql("session_counts", "events")
def _(q, events):
    """Sessions of users, half an hour of silence between two."""
    gap = "ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30' MINUTE"
    return f"SELECT user_id, max(s) AS sessions, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN coalesce(new_, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, {gap} AS new_ FROM {events}) a_) b_ GROUP BY user_id"


# -- what SQL of both dialects cannot say --------------------------------------------------------------
def frame(name):
    def keep(f):
        FRAMES[name] = f
        return f

    return keep


@frame("text_findings")
def _(spark, sf_dir):
    found = spans.scan_text(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.*")


@frame("text_redacted")
def _(spark, sf_dir):
    found = spans.scan_text(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", *[spans.redacted("text", "findings", s).alias(s.replace("-", "_")) for s in ("type-label", "asterisk", "placeholder")])


@frame("zone_blocks")
def _(spark, sf_dir):
    found = zones.with_zones(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.explode("zones").alias("z")).select("doc_id", "z.*")


@frame("zone_blocks_pages")
def _(spark, sf_dir):
    found = zones.with_zones(spread(read(spark, sf_dir, "pages").select("page_id", "html")), "html")
    return found.select("page_id", F.explode("zones").alias("z")).select("page_id", "z.*")


@frame("zone_summary")
def _(spark, sf_dir):
    return zones.summary(zones.with_zones(spread(read(spark, sf_dir, "conversations").select(prompts.prompt_id(F.col("conv_id"), F.col("turn")).alias("prompt_id"), "text"))), "prompt_id")


@frame("dominant_zone")
def _(spark, sf_dir):
    return zones.with_zones(spread(read(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", zones.dominant().alias("zone_type"))


@frame("unified_detect")
def _(spark, sf_dir):
    """Zones, secrets moved by zone, and the redacted text."""
    out = spans.detect(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", F.size("zones").alias("n_zones"), F.size("findings").alias("n_findings"), "redacted")


@frame("bulk_scan_counters")
def _(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("role = 'user' AND trim(text) <> ''")
    return prompts.counters(prompts.scanned(turns.select(prompts.prompt_id(F.col("conv_id"), F.col("turn")).alias("prompt_id"), "text")))


@frame("key_value_pairs")
def _(spark, sf_dir):
    out = structured.with_key_values(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", F.explode("pairs").alias("p")).select("doc_id", "p.*")


@frame("bitcoin_addresses")
def _(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{11,71})"), F.lit(0))).alias("address"))
    return docs.select("doc_id", "address", validators.bitcoin_address(F.col("address")).alias("valid"))


@frame("stream_scan")
def _(spark, sf_dir):
    schema = read(spark, sf_dir, "conversations").schema
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations*.parquet")
    out = jobs.scan_stream(turns).select("prompt_id", F.size("zones").alias("n_zones"), F.size("findings").alias("n_findings"))
    return jobs.drained(out, "stream-scan")


def _events(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


#: A stream gives a window or session once its watermark, the latest time less the delay, is past its end.
_PAST = "(SELECT max(ts) FROM events) - INTERVAL '10' MINUTE"
ORACLES["stream_window_counts"] = f"""SELECT "start", "start" + INTERVAL '5' MINUTE AS "end", event_type, n FROM (SELECT time_bucket(INTERVAL '5 minutes', ts) AS "start", event_type, count(*) AS n FROM events GROUP BY 1, 2) w WHERE "start" + INTERVAL '5' MINUTE <= {_PAST}"""
ORACLES["stream_sessions"] = f"""WITH a AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS new_ FROM events),
b AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL '30' MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS value FROM b GROUP BY user_id, s HAVING "end" <= {_PAST}"""


@frame("stream_window_counts")
def _(spark, sf_dir):
    return jobs.drained(jobs.counts(_events(spark, sf_dir)), "stream-counts")


@frame("stream_sessions")
def _(spark, sf_dir):
    return jobs.drained(jobs.sessions(_events(spark, sf_dir)), "stream-sessions").withColumn("value", F.round("value", 4))


_MAIL = _BY_NAME["email_address"].regex
ORACLES["redaction_of_given_spans"] = f"SELECT doc_id, {DUCK.replace('text', _MAIL, '[REDACTED:EMAIL]')} AS type_label, {DUCK.replace('text', _MAIL, '«secret»')} AS placeholder FROM documents WHERE text IS NOT NULL"


@frame("redaction_of_given_spans")
def _(spark, sf_dir):
    """Redaction alone: the spans are all addresses of a text, their places found by cutting the text at them."""
    cut = f"split(text, {SPARK.regex(_MAIL)}, -1)"
    at = "aggregate(slice(parts, 1, i + 1), 0, (a, x) -> a + length(x)) + aggregate(slice(hits, 1, i), 0, (a, x) -> a + length(x))"
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.expr(cut).alias("parts"), F.expr(SPARK.all("text", _MAIL)).alias("hits"))
    given = docs.withColumn("given", F.expr(f"transform(hits, (h, i) -> named_struct('entity_type', 'EMAIL', 'start', {at}, 'end', {at} + length(h)))"))
    return given.select("doc_id", *[spans.redacted("text", "given", s).alias(s.replace("-", "_")) for s in ("type-label", "placeholder")])


_CODED = "CASE WHEN line LIKE '%|%' THEN 'data' WHEN line LIKE '%=%' THEN 'config' WHEN length(line) % 7 = 0 THEN 'code' ELSE 'natural_language' END"
ORACLES["zones_of_given_blocks"] = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), z AS (SELECT doc_id, {_CODED} AS zone_type, count(*) AS n FROM l GROUP BY ALL)
SELECT doc_id, CAST(max(n) AS BIGINT) AS lines, min_by(zone_type, (-n, zone_type)) AS dominant, count(*) AS kinds FROM z GROUP BY doc_id"""


@frame("zones_of_given_blocks")
def _(spark, sf_dir):
    """Summary and dominant zone alone: each line is a block whose zone is read off the line."""
    kind = _CODED.replace("line", "x")
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.expr(f"transform(split(text, '\n'), (x, i) -> named_struct('start_line', i, 'end_line', i + 1, 'zone_type', {kind}, 'confidence', 1D))").alias("zones"))
    lines = zones.summary(docs, "doc_id").groupBy("doc_id").agg(F.max("lines").alias("lines"), F.count("*").alias("kinds"))
    return docs.select("doc_id", zones.dominant().alias("dominant")).join(lines, "doc_id").select("doc_id", F.col("lines").cast("bigint").alias("lines"), "dominant", "kinds")
