"""The database on disk: immutable manifests over Parquet change-log files."""

from .database import Database, Transaction
from .errors import ConflictError, CorruptionError, InvalidDataError, StoreError, StoreIOError

__all__ = ["ConflictError", "CorruptionError", "Database", "InvalidDataError", "StoreError", "StoreIOError", "Transaction"]
