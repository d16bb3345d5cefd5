import pytest

from sieveline.functions import validators
from sieveline.functions.dialect import DUCK, SPARK

CASES = {
    "luhn": (["4111111111111111", "378282246310005"], ["4111111111111112", "42", ""]),
    "luhn_strip": (["4111-1111 1111-1111"], ["4111-1111 1111-1112"]),
    "npi_luhn": (["1234567893"], ["1234567890", "123"]),
    "sin_luhn": (["046454286"], ["046454287"]),
    "ssn_zeros": (["123-45-6789", "123456789"], ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "078-05-1120", "12-345"]),
    "ipv4_not_reserved": (["10.0.0.1", "8.8.8.8"], ["0.1.2.3", "127.0.0.1", "224.0.0.1", "255.255.255.255", "169.254.1.1", "256.1.1.1", "1.2.3"]),
    "dea_checkdigit": (["AB1234563"], ["AB1234567", "A1234563"]),
    "vin_checkdigit": (["1HGCM82633A004352", "11111111111111111"], ["1HGCM82633A004353", "1HG"]),
    "ein_prefix": (["12-3456789", "98-7654321"], ["07-1234567", "1234"]),
    "aba_checksum": (["021000021"], ["021000022", "12"]),
    "iban_checksum": (["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], ["GB82WEST12345698765433", "DE"]),
    "phone_number": (["+1 415 555 0134", "415-555-0134 ext 7"], ["1111111", "1234567", "12"]),
    "aws_secret_not_hex": (["wJalrXUtnFEMI/K7MDENG"], ["deadbeef00", "alllower"]),
    "random_password": (["aB3!xyz", "abc-1234"], ["abcdef", "a!", "Abc1"]),
    "ethereum_address": (["0x52908400098527886E0F7030069857D2E4169EE7"], ["0x" + "0" * 40, "0x123"]),
    "not_placeholder_credential": (["q8Zt5Lp2"], ["changeme", "abcxxxxxdef", "aaaaaaaa", "your_password"]),
    "swift_bic_country_code": (["DEUTDEF0", "CHASUS33XXX"], ["DEUTZZF0", "ABCDDEFF", "SHORT1"]),
    "openai_legacy_key": (["sk-aB3"], ["sk-abc"]),
    "huggingface_token": (["hf_abc123DEF"], ["hf_camelCase_x"]),
    "bulgarian_egn": (["7523169263"], ["7523169264"]),
    "czech_rodne_cislo": (["710319/2745"], ["710319/2746", "719919/2745"]),
    "swiss_ahv": (["756.9217.0769.85"], ["756.9217.0769.84", "755.9217.0769.85"]),
    "danish_cpr": (["211062-5629"], ["211062-5628", "991062-5629"]),
    "german_steuerid": (["86095742719"], ["86095742718", "06095742719"]),
    "french_nir": (["255081416802538"], ["255081416802539"]),
    "spanish_dni": (["12345678Z"], ["12345678A"]),
    "spanish_nie": (["X1234567L"], ["X1234567A"]),
    "italian_codice_fiscale": (["RSSMRA85T10A562S"], ["RSSMRA85T10A562T"]),
    "dutch_bsn": (["111222333"], ["111222334", "000000000"]),
    "austrian_svnr": (["1237010180"], ["1236010180"]),
}


def test_every_validator_has_cases():
    assert set(CASES) == set(validators.VALIDATORS)


@pytest.fixture(scope="module")
def found(spark):
    out = {}
    for name, (good, bad) in CASES.items():
        df = spark.createDataFrame([(v,) for v in [*good, *bad, None]], "v string")
        out[name] = [r[0] for r in df.select(validators.column(name, "v")).collect()]
    return out


@pytest.mark.parametrize("name", CASES)
def test_accepts_and_rejects(found, name):
    good, bad = CASES[name]
    assert found[name] == [True] * len(good) + [False] * len(bad) + [None]


@pytest.mark.parametrize("name", CASES)
def test_both_dialects_agree(name):
    import duckdb

    good, bad = CASES[name]
    con = duckdb.connect()
    for v, want in [(x, True) for x in good] + [(x, False) for x in bad]:
        assert con.execute(f"SELECT {validators.sql(DUCK, name, 'v')} FROM (SELECT ? AS v)", [v]).fetchone()[0] is want, v


def test_bitcoin(spark):
    rows = [("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", True), ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", False), ("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", True), ("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", False), ("", False), (None, None)]
    df = spark.createDataFrame([(v,) for v, _ in rows], "v string")
    assert [r[0] for r in df.select(validators.column("bitcoin_address", "v")).collect()] == [w for _, w in rows]


def test_boundary_next_to_accents(spark):
    df = spark.createDataFrame([("é1234",), ("x1234",), ("1234",), ("12345",)], "v string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(F.expr(SPARK.like("v", r"%b[0-9]{4}%b"))).collect()] == [True, False, True, False]
