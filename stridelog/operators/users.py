"""User snapshots reduced to attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .maxima import greatest_text

_CREATED = ("created_at", F.min)


def user_meta(users: DataFrame) -> DataFrame:
    """Attributes per (id, email, username, domain, role), for snapshots with an email.

    An id with several emails, domains or roles keeps several rows.
    """
    return greatest_text(
        users.filter(F.col("email").isNotNull()).withColumnRenamed("session_uuid", "last_session_uuid"),
        ["id", "email", "username", "domain", "role"],
        ["license_type", "job_role", "personas", "plan", "salesforce_account_id", "last_session_uuid"],
        user_created_at=_CREATED,
        tenant_created_at=("tenant_created_at", F.min),
        last_identified_at=("received_at", F.max),
    )


def identities(users: DataFrame) -> DataFrame:
    """Attributes per (id, email, username, role), for snapshots with an email."""
    known = users.filter(F.col("email").isNotNull())
    return greatest_text(
        known,
        ["id", "email", "username", "role"],
        ["license_type", "job_role"],
        user_created_at=_CREATED,
    )


def user_latest(users: DataFrame, *columns: str, created: bool = False) -> DataFrame:
    """One row per id: the greatest value of each column, taken independently.

    ``created`` adds ``user_created_at``, the earliest creation time.
    """
    also = {"user_created_at": _CREATED} if created else {}
    return greatest_text(users, ["id"], columns, **also)


def user_created(users: DataFrame) -> DataFrame:
    """(id, user_created_at): the earliest creation time of each user."""
    column, extreme = _CREATED
    return users.groupBy("id").agg(extreme(column).alias("user_created_at"))
