"""Failures by kind. Messages never hold the statement's text or its values."""

from __future__ import annotations


class EngineError(Exception):
    """code is stable; retryable tells whether the same request may be sent again as it is."""

    code = "internal"
    retryable = False


class DataError(EngineError): ...


class OperationalError(EngineError): ...


class IntegrityError(EngineError): ...


class ProgrammingError(EngineError): ...


def _kind(name: str, code: str, base: type, retryable: bool = False) -> type:
    return type(name, (base,), {"code": code, "retryable": retryable, "__module__": __name__})


InvalidArgument = _kind("InvalidArgument", "invalid_argument", ProgrammingError)
NumericOutOfRange = _kind("NumericOutOfRange", "numeric_out_of_range", DataError)
InvalidTextEncoding = _kind("InvalidTextEncoding", "invalid_text_encoding", DataError)
InvalidQuery = _kind("InvalidQuery", "invalid_query", ProgrammingError)
Unsupported = _kind("Unsupported", "unsupported", ProgrammingError)
FailedPrecondition = _kind("FailedPrecondition", "failed_precondition", OperationalError)
TransactionAborted = _kind("TransactionAborted", "transaction_aborted", OperationalError)
TypeMismatch = _kind("TypeMismatch", "type_mismatch", DataError)
ConstraintViolation = _kind("ConstraintViolation", "constraint_violation", IntegrityError)
UniqueViolation = _kind("UniqueViolation", "unique_violation", ConstraintViolation)
NotNullViolation = _kind("NotNullViolation", "not_null_violation", ConstraintViolation)
ForeignKeyViolation = _kind("ForeignKeyViolation", "foreign_key_violation", ConstraintViolation)
CheckViolation = _kind("CheckViolation", "check_violation", ConstraintViolation)
PermissionDenied = _kind("PermissionDenied", "permission_denied", OperationalError)
ReadOnly = _kind("ReadOnly", "read_only", OperationalError)
Busy = _kind("Busy", "busy", OperationalError, retryable=True)
Cancelled = _kind("Cancelled", "cancelled", OperationalError)
DeadlineExceeded = _kind("DeadlineExceeded", "deadline_exceeded", OperationalError)
LimitExceeded = _kind("LimitExceeded", "limit_exceeded", OperationalError)
ShuttingDown = _kind("ShuttingDown", "shutting_down", OperationalError)
StorageFull = _kind("StorageFull", "storage_full", OperationalError)
OutOfMemory = _kind("OutOfMemory", "out_of_memory", OperationalError)
StorageUnavailable = _kind("StorageUnavailable", "storage_unavailable", OperationalError)
DataCorruption = _kind("DataCorruption", "data_corruption", OperationalError)
Internal = _kind("Internal", "internal", OperationalError)

KINDS = [
    InvalidArgument, NumericOutOfRange, InvalidTextEncoding, InvalidQuery, Unsupported, FailedPrecondition, TransactionAborted, TypeMismatch, ConstraintViolation,
    UniqueViolation, NotNullViolation, ForeignKeyViolation, CheckViolation, PermissionDenied, ReadOnly, Busy, Cancelled, DeadlineExceeded, LimitExceeded,
    ShuttingDown, StorageFull, OutOfMemory, StorageUnavailable, DataCorruption, Internal,
]
