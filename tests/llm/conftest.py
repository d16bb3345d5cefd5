import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

WORDS = {
    "en": "the of river stone garden window morning light walking under bridge children music paper winter summer kitchen letter mountain silver market harbour teacher story evening quiet yellow forest number answer minute doctor",
    "de": "der und nicht mit einem garten fenster morgen licht unter kinder musik papier sommer küche brief berg silber markt hafen lehrer geschichte abend ruhig gelb wald zahl antwort minute arzt straße größe",
    "fr": "le les dans avec une jardin fenêtre matin lumière sous pont enfants musique papier été cuisine lettre montagne argent marché port professeur histoire soir calme jaune forêt nombre réponse médecin",
    "es": "el los para con una jardín ventana mañana luz bajo puente niños música papel verano cocina carta montaña plata mercado puerto maestro historia tarde tranquilo amarillo bosque número respuesta médico",
}
WORDS = {k: v.split() for k, v in WORDS.items()}
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def frame(spark, rows, extra=()):
    """documents of (doc_id, text, lang, source) rows; ``extra``: names of further string columns."""
    schema = StructType([*DOCS.fields, *[StructField(c, StringType()) for c in extra]])
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), *[f"{c}-{i}" for c in extra]) for i, t, g, s in rows], schema)


#: Names that operators use inside, as columns of the table.
CLASHING = ["word", "line", "band", "bucket", "number", "first", "sig", "region", "rack", "shard", "cut_symbol", "symbol", "measure", "n", "a", "b", "s", "k", "low", "near", "codes", "class", "surrogate", "attempt", "item_id", "similarity", "keep_id"]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, "en", 40) for _ in range(2000))
    same = prose(rng, "fr", 60)
    return [
        (1, None, "en", "web"), (2, "", "en", "web"), (3, "   \n\t ", "en", "web"), (None, prose(rng, "en", 50), "en", "web"), (4, prose(rng, "de", 50), None, "web"),
        (5, prose(rng, "es", 50), "es", None), (6, same, "fr", "web"), (6, same, "fr", "web"), (7, same, "fr", "web"), (8, long, "en", "books"), (9, "a", "en", "web"), (10, "one two", "", ""), (11, "\n\n\n", "en", "web"),
        (12, "naïve café ☕ 𝒳   end", "fr", "web"), (13, None, None, None), (None, None, None, None),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows, CLASHING)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [], CLASHING)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def duck(spark, sql, **tables):
    """Rows of ``sql`` over DuckDB with these DataFrames as tables."""
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        t = df.toArrow()
        con.register(name, t)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, sorted((tuple(r) for r in cur.fetchall()), key=repr)
