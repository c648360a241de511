"""Stable identifiers."""
from pyspark.sql import Column, functions as F


def _hashed(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(value, 256), 1, 12)))


def company_id(domain: Column) -> Column:
    return _hashed("CMP-", domain)


def creator_id(handle: Column) -> Column:
    return _hashed("INF-", handle)
