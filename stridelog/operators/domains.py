"""User to customer-domain attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params
from ..sources.tables import Tables
from .maxima import greatest_text


def user_domains(pages: DataFrame, domain: str | None = None) -> DataFrame:
    """(user_id, domain): the greatest domain of each user's page views, over all history.

    With ``domain`` only the users attributed to it are returned. Rows with a smaller domain
    cannot change whether a user's maximum equals it, so they are dropped at the scan.
    """
    pairs = pages.select("user_id", "domain").filter(F.col("domain").isNotNull())
    if domain is not None:
        pairs = pairs.filter(F.col("domain") >= domain)
    greatest = greatest_text(pairs, ["user_id"], ["domain"])
    return greatest if domain is None else greatest.filter(F.col("domain") == domain)


def update_domains(old: DataFrame, new_pages: DataFrame) -> DataFrame:
    """The lookup after ``new_pages``, from the lookup before them; history is not read again.

    A maximum can be merged in any order, so late and repeated page views do no harm.
    """
    return greatest_text(old.unionByName(user_domains(new_pages)), ["user_id"], ["domain"])


def domains_of(t: Tables, domain: str | None = None) -> DataFrame:
    """The lookup for a report: the maintained table if there is one, else derived."""
    if t.domains is None:
        return user_domains(t.pages, domain)
    return t.domains if domain is None else t.domains.filter(F.col("domain") == domain)


def in_domain(rows: DataFrame, p: Params) -> DataFrame:
    """Rows whose own ``domain`` is the requested one; all rows if none is requested."""
    return rows if p.domain is None else rows.filter(F.col("domain") == p.domain)
