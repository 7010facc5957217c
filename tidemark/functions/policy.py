"""Message policies: redaction and blocking predicates (SC23 to SC26)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.dims import DANGEROUS_COMMANDS, DANGEROUS_TOOLS, ESCALATION, INJECTION, SECRET_KEYS, SECRETS


def redact(text: Column) -> Column:
    """SC24: known kinds of secrets replaced."""
    for pattern, replacement in SECRETS:
        text = F.regexp_replace(text, pattern, replacement.replace("{1}", "$1"))
    return text


def redact_map(values: Column) -> Column:
    """SC24: a map<string,string> with values under secret names masked and the others redacted."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(SECRET_KEYS), F.lit("[REDACTED]")).otherwise(redact(v)))


def is_injection(text: Column) -> Column:
    """SC25."""
    return F.coalesce(text, F.lit("")).rlike("(?i)" + INJECTION)


def is_escalation(text: Column) -> Column:
    """SC25."""
    return F.coalesce(text, F.lit("")).rlike("(?i)" + ESCALATION)


def dangerous_command(tool: Column, command: Column) -> Column:
    """SC25: the first pattern of a destructive command that the call matches, else null."""
    text = F.lower(F.concat(F.coalesce(tool, F.lit("")), F.lit(" "), F.coalesce(command, F.lit(""))))
    return F.coalesce(*[F.when(text.rlike(p), F.lit(p)) for p in DANGEROUS_COMMANDS])


def message_text(messages: Column) -> Column:
    """SC23: the texts of an array of struct<role, content>, one a line."""
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def blocked_before(text: Column) -> Column:
    """SC26: an injection that also asks for tools."""
    return is_injection(text) & is_escalation(text)


def blocked_after(text: Column, tools: Column) -> Column:
    """SC26: a dangerous tool call in an answer to an injection."""
    return F.exists(tools, lambda t: F.lower(t).isin(DANGEROUS_TOOLS)) & is_injection(text)
