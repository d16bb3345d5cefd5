"""Vocabulary and row types shared by the engines, passes and roll-ups."""

from __future__ import annotations

#: Ordinal of a sensitivity; an unknown one counts as the lowest.
SENSITIVITY = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
CATEGORIES = ("Credential", "Financial", "Health", "PII")

_FAMILY_MEMBERS = {
    "CONTACT": "ADDRESS EMAIL PERSON_NAME PHONE",
    "CREDENTIAL": "API_KEY CREDENTIAL OPAQUE_SECRET PASSWORD_HASH PRIVATE_KEY",
    "CRYPTO": "BITCOIN_ADDRESS ETHEREUM_ADDRESS",
    "DATE": "DATE DATE_OF_BIRTH",
    "DEMOGRAPHIC": "AGE DEMOGRAPHIC",
    "FINANCIAL": "ABA_ROUTING BANK_ACCOUNT FINANCIAL IBAN SWIFT_BIC",
    "GOVERNMENT_ID": "CANADIAN_SIN EIN NATIONAL_ID SSN",
    "HEALTHCARE": "DEA_NUMBER HEALTH MBI NPI",
    "NEGATIVE": "NEGATIVE",
    "NETWORK": "IP_ADDRESS MAC_ADDRESS",
    "PAYMENT_CARD": "CREDIT_CARD",
    "URL": "URL",
    "VEHICLE": "VIN",
}
FAMILIES = tuple(_FAMILY_MEMBERS)
#: Entity type -> family; a type that is not here is a family of its own, an empty one has none.
FAMILY = {e: f for f, es in _FAMILY_MEMBERS.items() for e in es.split()}

#: Rank of a type within its family, 0 if not listed.
SPECIFICITY = {e: n for n, es in ((3, "ADDRESS EMAIL PHONE API_KEY PRIVATE_KEY PASSWORD_HASH SSN CANADIAN_SIN EIN"), (2, "OPAQUE_SECRET NATIONAL_ID"), (1, "PERSON_NAME CREDENTIAL")) for e in es.split()}

#: Types that point to the domain of a table, and what a domain adds to the confidence of a type.
DOMAIN_SIGNALS = {
    "customer_pii": "ADDRESS CANADIAN_SIN DATE_OF_BIRTH DRIVERS_LICENSE EMAIL FIRST_NAME LAST_NAME NATIONAL_ID PASSPORT PHONE SSN".split(),
    "financial": "ABA_ROUTING BANK_ACCOUNT BIC CREDIT_CARD IBAN SALARY".split(),
    "healthcare": "DEA_NUMBER DIAGNOSIS ICD_CODE MEDICARE_BENEFICIARY MEDICATION MRN NPI".split(),
}
DOMAIN_DELTAS = {
    "customer_pii": {"ABA_ROUTING": -0.1, "CANADIAN_SIN": 0.05, "EMAIL": 0.05, "NPI": -0.1, "PHONE": 0.05, "SSN": 0.1},
    "financial": {"ABA_ROUTING": 0.1, "BANK_ACCOUNT": 0.1, "CREDIT_CARD": 0.05, "IBAN": 0.05, "NPI": -0.1, "SSN": -0.05},
    "healthcare": {"ABA_ROUTING": -0.1, "DEA_NUMBER": 0.1, "DIAGNOSIS": 0.1, "MRN": 0.1, "NPI": 0.1, "PHONE": -0.05, "SSN": 0.05},
}

#: Engine -> (order, authority).
ENGINES = {"column_name": (1, 10), "regex": (2, 5), "heuristic_stats": (3, 1), "secret_scanner": (4, 1), "model": (5, 1)}

NON_TEXT_TYPES = "BIGINT BOOLEAN BYTES DATE DATETIME DECIMAL DOUBLE FLOAT INT INTEGER NUMERIC TIME TIMESTAMP".split()

FINDING = "column_id string, entity_type string, category string, sensitivity string, confidence double, regulatory array<string>, engine string, authority int, seq int, evidence string, detection_type string, matched bigint, validated bigint, scanned bigint, matches array<string>"
COLUMNS = "group_id string, column_id string, column_name string, table_name string, data_type string"
SAMPLES = "column_id string, pos bigint, value string"


def family(entity_type: str | None) -> str:
    return FAMILY.get(entity_type, entity_type) if entity_type else ""


def case(value: str, table: dict, otherwise: str) -> str:
    """A small map as a CASE expression, the same in both dialects."""
    lit = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {value} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"
