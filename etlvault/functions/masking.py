"""Masks per entity type, encryption of cells and the card checksum."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SECRET_CONF = "spark.etlvault.pii.secret"


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mask_generic(value: Column) -> Column:
    """First and last character; two characters or fewer become stars."""
    n = F.length(value)
    return F.when(n <= 2, _stars(n)).otherwise(
        F.concat(F.left(value, F.lit(1)), _stars(n - 2), F.right(value, F.lit(1))))


def mask_email(value: Column) -> Column:
    """Local part starred, domain kept; without ``@`` the generic mask."""
    at = F.locate("@", value)
    return F.when(at > 0, F.concat(_stars(at - 1), F.substring(value, at, F.length(value)))).otherwise(mask_generic(value))


def mask_card(value: Column) -> Column:
    """Separators dropped, last four kept."""
    plain = F.regexp_replace(value, "[- ]", "")
    return F.concat(_stars(F.greatest(F.length(plain) - 4, F.lit(0))), F.right(plain, F.lit(4)))


def mask_ssn(value: Column) -> Column:
    return F.when(F.length(value) >= 4, F.concat(F.lit("***-**-"), F.right(value, F.lit(4)))).otherwise(F.lit("***-**-****"))


def mask_phone(value: Column) -> Column:
    """Digits only, last four kept; fewer than four digits give stars for every character."""
    plain = _digits(value)
    n = F.length(plain)
    return F.when(n >= 4, F.concat(_stars(n - 4), F.right(plain, F.lit(4)))).otherwise(_stars(F.length(value)))


def mask_ip(value: Column) -> Column:
    parts = F.split(value, "\\.")
    return F.when(F.size(parts) == 4, F.concat(F.lit("*.*.*."), F.element_at(parts, 4))).otherwise(F.lit("*.*.*.*"))


_MASKS = {"EMAIL_ADDRESS": mask_email, "CREDIT_CARD": mask_card, "US_SSN": mask_ssn,
          "PHONE_NUMBER": mask_phone, "IP_ADDRESS": mask_ip}


def mask(value: Column, entity: Column) -> Column:
    """Mask the whole value by the entity found in it."""
    picked = F
    for name, rule in _MASKS.items():
        picked = picked.when(entity == name, rule(value))
    return picked.otherwise(mask_generic(value))


def encrypt(value: Column, key: Column) -> Column:
    """AES-GCM with a random vector, as base64 text."""
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def decrypt(token: Column, key: Column) -> Column:
    """The original text, or NULL when the token does not open with this key."""
    return F.try_aes_decrypt(F.try_to_binary(token, F.lit("base64")), key, F.lit("GCM")).cast("string")


def secret(spark: SparkSession, value: str | None = None) -> Column:
    """The key as a scalar subquery, so that no plan, log or table shows it.

    Taken from the session conf, whose name Spark's redaction covers, unless given.
    """
    text = value if value is not None else spark.conf.get(SECRET_CONF)
    return spark.createDataFrame([(text,)], "k string").scalar()


def fingerprint(spark: SparkSession, value: str | None = None) -> Column:
    """SHA-256 of the key, which may be stored beside a key id."""
    return F.sha2(secret(spark, value), 256)


def luhn(value: Column) -> Column:
    """Card checksum over the digits of ``value``."""
    return F.call_function("luhn_check", _digits(value))
