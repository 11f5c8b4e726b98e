"""Errors of the engine; each has a stable code for callers that map them to responses."""

from __future__ import annotations


class EngineError(Exception):
    code = "internal"


class ConfigurationError(EngineError):
    code = "configuration"


class UnknownEntity(EngineError):
    code = "entity_not_registered"


class UnknownColumn(EngineError):
    code = "unknown_column"


class UnknownNavigation(EngineError):
    code = "unknown_navigation"


class InvalidQuery(EngineError):
    code = "query"


class NotFound(EngineError):
    code = "not_found"


class NotUnique(EngineError):
    code = "more_than_one"


class ConversionError(EngineError):
    code = "type_conversion"


class Unsupported(EngineError):
    code = "unsupported"


class ConcurrencyConflict(EngineError):
    code = "concurrency_conflict"


class ConstraintViolation(EngineError):
    code = "constraint"


class UniqueViolation(ConstraintViolation):
    code = "unique_violation"


class ForeignKeyViolation(ConstraintViolation):
    code = "foreign_key_violation"


class CheckViolation(ConstraintViolation):
    code = "check_violation"


class RequiredViolation(ConstraintViolation):
    code = "not_null_violation"


class MigrationError(EngineError):
    code = "migration"


class TransactionError(EngineError):
    code = "transaction"


class ConnectionFailed(EngineError):
    code = "connection"
