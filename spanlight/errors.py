"""Errors and their catalogue: what each kind means to a caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SpanlightError(Exception):
    """Base of all errors; the subclass says the kind."""

    kind, exit_code, outcome, retryable = "internal", 70, "failed", False


class UsageError(SpanlightError):
    kind, exit_code, outcome = "usage", 2, "refused"


class SettingsError(SpanlightError):
    kind, exit_code, outcome = "settings", 3, "refused"


class StorageError(SpanlightError):
    kind, exit_code, outcome = "storage", 4, "failed"


class BusyError(SpanlightError):
    kind, exit_code, outcome, retryable = "busy", 5, "failed", True


class ContractError(SpanlightError):
    kind, exit_code, outcome = "contract", 6, "refused"


class AnswerError(SpanlightError):
    kind, exit_code, outcome = "answer", 7, "refused"


class ProtectedError(SpanlightError):
    kind, exit_code, outcome = "protected", 8, "refused"


class ProviderError(SpanlightError):
    kind, exit_code, outcome, retryable = "provider", 9, "failed", True


CATALOGUE = (SpanlightError, UsageError, SettingsError, StorageError, BusyError, ContractError, AnswerError, ProtectedError, ProviderError)


def catalogue(spark: SparkSession) -> DataFrame:
    """(kind, exit_code, outcome, retryable) of every error."""
    return spark.createDataFrame([(e.kind, e.exit_code, e.outcome, e.retryable) for e in CATALOGUE], "kind string, exit_code int, outcome string, retryable boolean")
