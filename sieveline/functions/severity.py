"""Severities, confidences and the first of scalar-or-list fields (projections 6, 13 to 15 and 17; traps 9 and 10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from the worst down; external names and what they stand for.
ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
EXTERNAL = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}
WEB = ("critical", "high", "medium", "low")


def normalize(severity: Column, mode: str = "own") -> Column:
    """One vocabulary. own: upper case, unknown is MEDIUM. external: ERROR, WARNING, INFO mapped, else MEDIUM. upper: only
    upper case. both: external names first, then the own ones. web: lower case with four levels."""
    up = F.upper(F.trim(severity))
    mapped = F.coalesce(*(F.when(up == k, F.lit(v)) for k, v in EXTERNAL.items()), F.lit("MEDIUM"))
    own = F.when(up.isin(*ORDER), up).otherwise(F.lit("MEDIUM"))
    if mode == "external":
        return mapped
    if mode == "upper":
        return F.upper(severity)
    if mode == "both":
        return F.when(up.isin("ERROR", "WARNING"), mapped).otherwise(own)
    if mode == "web":
        return F.lower(F.when(own == "INFO", F.lit("LOW")).otherwise(own))
    return own


def rank(severity: Column) -> Column:
    """0 for the worst; unknown ones rank behind all (the unknown of a map look-up would rank first)."""
    return F.coalesce(*(F.when(severity == s, F.lit(k)) for k, s in enumerate(ORDER)), F.lit(len(ORDER)))


def confidence_score(severity: Column, matched: Column, line: Column) -> Column:
    """A match's score between 0.1 and 0.95 (projection 17)."""
    sev, text, all_ = F.lower(severity), F.lower(matched), F.trim(line)
    bonus = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    score = F.lit(0.5) + F.when(sev == "critical", 0.2).when(sev == "high", 0.15).otherwise(0.0) + bonus(text.contains("password") | text.contains("secret"), 0.2) + bonus(text.contains("user") | text.contains("input"), 0.1) - bonus(all_.contains("//") | all_.contains("#"), 0.1)
    return F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.1), score)), 4)


def first_of(variant: str, path: str, mode: str = "first") -> Column:
    """A text, or the first text of a list, of a field of a VARIANT column; null for any other type.

    mode text: lists give nothing (what one of the loaders does with this field)."""
    at = lambda p: F.expr(f"case when schema_of_variant(try_variant_get({variant}, '{p}', 'variant')) = 'STRING' then try_variant_get({variant}, '{p}', 'string') end")
    return at(path) if mode == "text" else F.coalesce(at(path), at(f"{path}[0]"))


def or_else(*values: Column) -> Column:
    """The first that is neither null nor empty (projection 15)."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))
