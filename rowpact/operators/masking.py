"""Hiding secrets in logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from rowpact.contract import Contract
from rowpact.functions.scalars import mask


def mask_named(text: Column, secret_names: Sequence[str]) -> Column:
    """Mask a text that mentions the name of a secret column."""
    if not secret_names:
        return text
    mentions = text.contains(secret_names[0])
    for name in secret_names[1:]:
        mentions |= text.contains(name)
    return F.when(mentions, mask(text)).otherwise(text)


def mask_column_value(column: Column, value: Column, contract: Contract) -> Column:
    """Mask the value of a secret column, and any text that mentions one."""
    if not contract.secret_names:
        return value
    return F.when(column.isin(*contract.secret_names), mask(value)).otherwise(
        mask_named(value, contract.secret_names))
