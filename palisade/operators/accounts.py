"""Account tables: address and name checks, token states and login eligibility."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions import text
from palisade.operators.ranking import with_next

# Limits and patterns of addresses and names.
EMAIL_LIMIT, NAME_LOW, NAME_HIGH = 255, 2, 100
EMAIL_PATTERN = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"
CONTROL_CHARACTERS = r"[\x00-\x1f\x7f]"


def normal_email(email: Column) -> Column:
    return F.lower(text.strip(email))


def duplicate_emails(users: DataFrame) -> DataFrame:
    """Addresses used more than once, whatever the case."""
    counted = users.groupBy(normal_email(F.col("email")).alias("email")).agg(F.count("*").alias("accounts"))
    return counted.filter("accounts > 1")


def email_errors(email: Column) -> Column:
    address = normal_email(email)
    return F.array_compact(F.array(
        F.when(address == "", "Email address is required."),
        F.when(F.char_length(address) > EMAIL_LIMIT, f"Email address must not exceed {EMAIL_LIMIT} characters."),
        F.when((address != "") & ~address.rlike(EMAIL_PATTERN), "Enter a valid email address."),
        F.when(address.rlike(CONTROL_CHARACTERS), "Email address contains invalid characters."),
    ))


def name_errors(name: Column) -> Column:
    full = text.collapse(name)
    return F.array_compact(F.array(
        F.when(full == "", "Full name is required."),
        F.when((full != "") & (F.char_length(full) < NAME_LOW), f"Full name must contain at least {NAME_LOW} characters."),
        F.when(F.char_length(full) > NAME_HIGH, f"Full name must not exceed {NAME_HIGH} characters."),
        F.when(full.rlike(CONTROL_CHARACTERS), "Full name contains invalid characters."),
    ))


def token_state(used_at: Column, expires_at: Column, now: datetime | Column) -> Column:
    moment = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    return F.when(used_at.isNotNull(), "used").when(expires_at <= moment, "expired").otherwise("active")


def supersede(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Unused tokens count as used from the moment the user gets the next token of the kind."""
    following = with_next(tokens, keys, "created_at", "token_id", "superseded_at")
    return following.withColumn("used_at", F.least("used_at", "superseded_at"))


def login_eligible(users: DataFrame) -> DataFrame:
    return users.filter((F.lower("status") == "active") & F.col("is_email_verified"))
