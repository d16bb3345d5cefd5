"""Validators: string -> boolean, as SQL expressions so that they stay in generated code.

Every builder takes a dialect and the SQL of a non-null string and gives the SQL of a boolean.
``column`` makes a Spark column of one; a null value gives null. Digits are ASCII throughout.
``bitcoin_address`` alone needs base-58 arithmetic over bytes and is an Arrow function.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..patterns import placeholders
from .dialect import SPARK, Dialect

Builder = Callable[[Dialect, str], str]


def _digits(q: Dialect, v: str) -> str:
    return q.replace(v, "[^0-9]")


def _bare(q: Dialect, v: str, drop: str) -> str:
    return q.replace(v, drop)


def _at(d: str, i: int) -> str:
    """Digit ``i``, counted from 0, of a text known to hold only digits there."""
    return f"CAST(substr({d}, {i + 1}, 1) AS INT)"


def _weighted(d: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"{_at(d, i)} * {w}" for i, w in enumerate(weights) if w) + ")"


def _part(d: str, start: int, size: int) -> str:
    return f"CAST(substr({d}, {start + 1}, {size}) AS BIGINT)"


def _when(test: str, then: str) -> str:
    return f"(CASE WHEN {test} THEN {then} ELSE false END)"


def luhn(q: Dialect, v: str) -> str:
    d = _digits(q, v)
    return _when(f"length({d}) >= 13", q.luhn(d))


def luhn_strip(q: Dialect, v: str) -> str:
    return luhn(q, q.replace(v, "[- ]"))


def npi_luhn(q: Dialect, v: str) -> str:
    d = _digits(q, v)
    return _when(f"length({d}) = 10", q.luhn(f"concat('80840', {d})"))


def sin_luhn(q: Dialect, v: str) -> str:
    d = _digits(q, v)
    return _when(f"length({d}) = 9", q.luhn(d))


def ssn_zeros(q: Dialect, v: str) -> str:
    d = f"replace({v}, '-', '')"
    area, group, serial = f"substr({d}, 1, 3)", f"substr({d}, 4, 2)", f"substr({d}, 6, 4)"
    ok = f"{group} <> '00' AND {serial} <> '0000' AND {area} NOT IN ('000', '666') AND {area} < '900' AND {d} NOT IN ('078051120', '219099999')"
    return _when(q.like(d, "^[0-9]{9}$"), ok)


def ipv4_not_reserved(q: Dialect, v: str) -> str:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    first = f"CAST({q.first(v, '^[0-9]+')} AS INT)"
    return _when(q.like(v, rf"^{octet}([.]{octet}){{3}}$"), f"{first} NOT IN (0, 127) AND {first} < 224 AND NOT {q.like(v, '^169[.]254[.]')}")


def dea_checkdigit(q: Dialect, v: str) -> str:
    return _when(q.like(v, "^..[0-9]{7}$"), f"{_weighted(v, [0, 0, 1, 2, 1, 2, 1, 2])} % 10 = {_at(v, 8)}")


_VIN_VALUES = {c: n for n, cs in enumerate(["", "AJ", "BKS", "CLT", "DMU", "ENV", "FW", "GPX", "HY", "RZ"]) for c in cs}


def vin_checkdigit(q: Dialect, v: str) -> str:
    u = f"upper({v})"
    keys, vals = "".join(_VIN_VALUES), "".join(map(str, _VIN_VALUES.values()))
    plain = q.replace(f"translate({u}, '{keys}', '{vals}')", "[^0-9]", "0")
    total = _weighted(plain, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2])
    return _when(f"length({v}) = 17", f"substr({u}, 9, 1) = substr('0123456789X', CAST({total} % 11 AS INT) + 1, 1)")


def ein_prefix(q: Dialect, v: str) -> str:
    d = f"replace({v}, '-', '')"
    p = f"CAST(substr({d}, 1, 2) AS INT)"
    spans = " OR ".join(f"{p} BETWEEN {a} AND {b}" for a, b in ((1, 6), (10, 16), (20, 27), (30, 39), (40, 48), (50, 68), (71, 77), (80, 88), (90, 95), (98, 99)))
    return _when(f"length({d}) = 9 AND {q.like(d, '^[0-9][0-9]')}", spans)


def aba_checksum(q: Dialect, v: str) -> str:
    d = _digits(q, v)
    return _when(f"length({d}) = 9", f"{_weighted(d, [3, 7, 1] * 3)} % 10 = 0")


def iban_checksum(q: Dialect, v: str) -> str:
    """Up to the 34 characters an IBAN can have."""
    c = f"upper({q.replace(v, '[ -]')})"
    turned = f"concat(substr({c}, 5), substr({c}, 1, 4))"
    places = q.map(q.chars(turned), "c_", "CAST(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c_) - 1 AS BIGINT)")
    total = q.fold(places, "a_, x_", "CAST((a_ * (CASE WHEN x_ > 9 THEN 100 ELSE 10 END) + x_) % 97 AS BIGINT)")
    return _when(q.like(c, "^[0-9A-Z]{5,34}$"), f"{total} = 1")


def phone_number(q: Dialect, v: str) -> str:
    d = _digits(q, q.replace(v, r"(?i)\s*(?:ext[.]?|x|#)\s*[0-9]+\s*$"))
    runs = " OR ".join(f"contains('{s}', {d})" for s in ("01234567890123456", "98765432109876543"))
    return _when(f"length({d}) BETWEEN 7 AND 15", f"replace({d}, substr({d}, 1, 1), '') <> '' AND NOT ({runs})")


def aws_secret_not_hex(q: Dialect, v: str) -> str:
    return f"(NOT {q.like(v, '^[0-9A-Fa-f]*$')} AND {q.like(v, '[a-z]')} AND {q.like(v, '[A-Z]')})"


def random_password(q: Dialect, v: str) -> str:
    has = lambda p: f"CAST({q.like(v, p)} AS INT)"
    return _when(f"length({v}) BETWEEN 4 AND 64 AND {q.like(v, r'[^0-9A-Za-z\s]')}", f"{has('[a-z]')} + {has('[A-Z]')} + {has('[0-9]')} + 1 >= 3")


def ethereum_address(q: Dialect, v: str) -> str:
    body = f"lower(substr({v}, 3))"
    return _when(q.like(v, "^0x[0-9A-Fa-f]{40}$"), f"{body} NOT IN ('{'0' * 40}', '{'f' * 40}', '{'deadbeef' * 5}')")


def not_placeholder_credential(q: Dialect, v: str) -> str:
    t = f"trim({v})"
    repeated = f"({t} RLIKE r'(.)\\1{{7,}}')" if q.spark else "regexp_matches(" + t + ", '" + "|".join(f"{c}{{8,}}" for c in [*"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *(rf"\x{ord(c):02x}" for c in " !\"#$%&'()*+,-./:;<=>?@[]^_`{|}~")]) + "')"
    start = r"""(?i)(?:^|[=:\s"'])(?:your|my|insert|put|replace|add|enter)[_\-\s]"""
    return f"NOT ({q.any_in(f'lower({t})', placeholders())} OR {q.like(t, '[xX]{5,}')} OR {repeated} OR {q.like(t, start)})"


_COUNTRIES = (
    "AD AE AF AG AI AL AM AO AQ AR AS AT AU AW AX AZ BA BB BD BE BF BG BH BI BJ BL BM BN BO BQ BR BS BT BV BW BY BZ CA CC CD CF CG CH CI CK CL CM CN CO CR CU CV CW CX CY CZ DE DJ DK DM DO DZ EC EE EG EH ER ES ET FI FJ FK FM FO FR GA GB GD GE GF GG GH GI GL GM GN GP GQ GR GS GT GU GW GY HK HM HN HR HT HU ID IE IL IM IN IO IQ IR IS IT JE JM JO JP KE KG KH KI KM KN KP KR KW KY KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MF MG MH MK ML MM MN MO MP MQ MR MS MT MU MV MW MX MY MZ NA NC NE NF NG NI NL NO NP NR NU NZ OM PA PE PF PG PH PK PL PM PN PR PS PT PW PY QA RE RO RS RU RW SA SB SC SD SE SG SH SI SJ SK SL SM SN SO SR SS ST SV SX SY SZ TC TD TF TG TH TJ TK TL TM TN TO TR TT TV TW TZ UA UG UM US UY UZ VA VC VE VG VI VN VU WF WS YE YT ZA ZM ZW XK"
).split()


def swift_bic_country_code(q: Dialect, v: str) -> str:
    c = f"upper(trim({v}))"
    return _when(f"length({c}) IN (8, 11)", f"{q.any_in(f'substr({c}, 5, 2)', _COUNTRIES)} AND NOT {q.like(c, '^[A-Z]+$')}")


def openai_legacy_key(q: Dialect, v: str) -> str:
    s = q.replace(v, "^sk-")
    return "(" + " + ".join(f"CAST({q.like(s, p)} AS INT)" for p in ("[A-Z]", "[a-z]", "[0-9]")) + " >= 2)"


def huggingface_token(q: Dialect, v: str) -> str:
    s = q.replace(v, "^hf_")
    return f"NOT ({q.like(s, '[a-z][A-Z]')} AND NOT {q.like(s, '[0-9]')} AND (length({s}) > 40 OR NOT {q.like(s, '^[0-9A-Za-z]+$')}))"


def bulgarian_egn(q: Dialect, v: str) -> str:
    d = _digits(q, v)
    return _when(f"length({d}) = 10", f"({_weighted(d, [2, 4, 8, 5, 10, 9, 7, 3, 6])} % 11) % 10 = {_at(d, 9)}")


def czech_rodne_cislo(q: Dialect, v: str) -> str:
    d = _bare(q, v, r"[/\s-]")
    m, day = _part(d, 2, 2), _part(d, 4, 2)
    return _when(q.like(d, "^[0-9]{10}$"), f"({m} BETWEEN 1 AND 12 OR {m} BETWEEN 21 AND 32 OR {m} BETWEEN 51 AND 62) AND {day} BETWEEN 1 AND 31 AND CAST({d} AS BIGINT) % 11 = 0")


def swiss_ahv(q: Dialect, v: str) -> str:
    d = _digits(q, v)
    return _when(f"length({d}) = 13 AND substr({d}, 1, 3) = '756'", f"({_weighted(d, [1, 3] * 6)} + {_at(d, 12)}) % 10 = 0")


def danish_cpr(q: Dialect, v: str) -> str:
    d = _bare(q, v, r"[/\s-]")
    return _when(q.like(d, "^[0-9]{10}$"), f"{_part(d, 0, 2)} BETWEEN 1 AND 31 AND {_part(d, 2, 2)} BETWEEN 1 AND 12 AND {_weighted(d, [4, 3, 2, 7, 6, 5, 4, 3, 2, 1])} % 11 = 0")


def german_steuerid(q: Dialect, v: str) -> str:
    d = _bare(q, v, r"[\s.-]")
    product = "10"
    for i in range(10):
        # (s or 10) * 2 % 11 with s = (digit + product) % 10, the product used once
        product = f"((((({_at(d, i)} + {product}) + 9) % 10) + 1) * 2 % 11)"
    return _when(q.like(d, "^[1-9][0-9]{10}$"), f"(11 - {product}) % 10 = {_at(d, 10)}")


def french_nir(q: Dialect, v: str) -> str:
    d = _bare(q, v, r"[\s.-]")
    return _when(q.like(d, "^[12378][0-9]{14}$"), f"{_part(d, 13, 2)} = 97 - {_part(d, 0, 13)} % 97")


def _letter(n: str) -> str:
    return f"substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST({n} % 23 AS INT) + 1, 1)"


def spanish_dni(q: Dialect, v: str) -> str:
    c = f"upper({_bare(q, v, r'[\s-]')})"
    return _when(q.like(c, "^[0-9]{8}[A-Z]$"), f"{_letter(_part(c, 0, 8))} = substr({c}, 9, 1)")


def spanish_nie(q: Dialect, v: str) -> str:
    c = f"upper({_bare(q, v, r'[\s-]')})"
    n = f"CAST(concat(translate(substr({c}, 1, 1), 'XYZ', '012'), substr({c}, 2, 7)) AS BIGINT)"
    return _when(q.like(c, "^[XYZ][0-9]{7}[A-Z]$"), f"{_letter(n)} = substr({c}, 9, 1)")


_ODD_ORDER = "BAKPLCQDREVOSFTGUHMINJWZYX"


def italian_codice_fiscale(q: Dialect, v: str) -> str:
    c = f"upper(trim({v}))"
    # digits stand for the letters A..J; an odd place is worth the rank of its letter in _ODD_ORDER
    flat = f"translate({c}, '0123456789', 'ABCDEFGHIJ')"
    odd = " + ".join(f"instr('{_ODD_ORDER}', substr({flat}, {i}, 1)) - 1" for i in range(1, 16, 2))
    even = " + ".join(f"instr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({flat}, {i}, 1)) - 1" for i in range(2, 16, 2))
    return _when(q.like(c, "^[0-9A-Z]{15}[A-Z]$"), f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(({odd} + {even}) % 26 AS INT) + 1, 1) = substr({c}, 16, 1)")


def dutch_bsn(q: Dialect, v: str) -> str:
    d = _bare(q, v, r"[\s.-]")
    t = _weighted(d, [9, 8, 7, 6, 5, 4, 3, 2, -1])
    return _when(q.like(d, "^[1-9][0-9]{8}$"), f"{t} % 11 = 0 AND {t} <> 0")


def austrian_svnr(q: Dialect, v: str) -> str:
    d = _bare(q, v, r"[\s.-]")
    return _when(q.like(d, "^[1-9][0-9]{9}$"), f"{_weighted(d, [3, 7, 9, 0, 5, 8, 4, 2, 1, 6])} % 11 = {_at(d, 3)}")


VALIDATORS: dict[str, Builder] = {
    f.__name__: f
    for f in (
        luhn, luhn_strip, npi_luhn, sin_luhn, ssn_zeros, ipv4_not_reserved, dea_checkdigit, vin_checkdigit, ein_prefix, aba_checksum, iban_checksum, phone_number, aws_secret_not_hex, random_password, ethereum_address, not_placeholder_credential, swift_bic_country_code,
        openai_legacy_key, huggingface_token, bulgarian_egn, czech_rodne_cislo, swiss_ahv, danish_cpr, german_steuerid, french_nir, spanish_dni, spanish_nie, italian_codice_fiscale, dutch_bsn, austrian_svnr,
    )
}

_B58 = {c: i for i, c in enumerate("123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz")}
_B32 = {c: i for i, c in enumerate("qpzry9x8gf2tvdw0s3jn54khce6mua7l")}


def is_bitcoin_address(v: str) -> bool:
    """Base-58 with its checksum, or bech32 / bech32m with theirs."""
    if v.lower().startswith("bc1"):
        if v not in (v.lower(), v.upper()) or not 14 <= len(v) <= 90:
            return False
        data = [_B32.get(c, -1) for c in v.lower()[3:]]
        if min(data) < 0:
            return False
        check = 1
        for x in [3, 3, 0, 2, 3, *data]:
            top = check >> 25
            check = (check & 0x1FFFFFF) << 5 ^ x
            for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
                check ^= g if top >> i & 1 else 0
        return check == (1 if data[0] == 0 else 0x2BC830A3)
    if not v or any(c not in _B58 for c in v):
        return False
    n = 0
    for c in v:
        n = n * 58 + _B58[c]
    raw = b"\0" * (len(v) - len(v.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return len(raw) == 25 and raw[0] in (0, 5) and hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def bitcoin_address(v: Column) -> Column:
    @F.pandas_udf("boolean")
    def check(s):
        return s.map(is_bitcoin_address, na_action="ignore")

    return check(v)


def column(name: str, v: str) -> Column:
    """The validator ``name`` over a column given by name (or SQL); null stays null."""
    return bitcoin_address(F.expr(v)) if name == "bitcoin_address" else F.expr(sql(SPARK, name, v))


def sql(q: Dialect, name: str, v: str) -> str:
    return f"(CASE WHEN {v} IS NOT NULL THEN {VALIDATORS[name](q, v)} END)"
