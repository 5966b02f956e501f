"""Status codes instead of exceptions, for callers across a language border."""

from __future__ import annotations

import threading
from enum import IntEnum

from pyspark.sql import SparkSession

from .database import Database
from .errors import ConflictError

_state = threading.local()


class Status(IntEnum):
    OK = 0
    NOT_FOUND = 1
    NULL = 2
    INVALID = 3
    ERROR = 10
    CONFLICT = 11


def _guarded(call) -> tuple[Status, object]:
    """Runs call; a success clears the last error."""
    try:
        got = call()
    except ConflictError as e:
        _state.error = str(e)
        return Status.CONFLICT, None
    except Exception as e:  # noqa: BLE001  nothing may cross the border
        _state.error = str(e)
        return Status.ERROR, None
    _state.error = ""
    return Status.OK, got


def last_error() -> str:
    return getattr(_state, "error", "")


def open_database(spark: SparkSession | None, path: bytes | None) -> tuple[Status, Database | None]:
    if spark is None or path is None:
        return Status.NULL, None
    try:
        name = path.decode()
    except UnicodeDecodeError:
        return Status.INVALID, None
    return _guarded(lambda: Database.open(spark, name))


def close(db: Database | None) -> Status:
    return _guarded(db.stop_background)[0] if db else Status.OK


def put(db: Database | None, key: bytes | None, value: bytes | None) -> Status:
    return Status.NULL if db is None or key is None or value is None else _guarded(lambda: db.set(key, value))[0]


def delete(db: Database | None, key: bytes | None) -> Status:
    return Status.NULL if db is None or key is None else _guarded(lambda: db.delete(key))[0]


def get(db: Database | None, key: bytes | None) -> tuple[Status, bytes | None]:
    if db is None or key is None:
        return Status.NULL, None
    status, value = _guarded(lambda: db.get(key))
    return (Status.NOT_FOUND, None) if status == Status.OK and value is None else (status, value)


def checkpoint(db: Database | None) -> Status:
    return Status.NULL if db is None else _guarded(db.checkpoint)[0]
