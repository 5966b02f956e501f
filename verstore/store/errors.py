"""What the store raises."""


class StoreError(Exception):
    """Base of all of the store's errors."""


class StoreIOError(StoreError):
    """The file system failed."""


class CorruptionError(StoreError):
    """Stored data is missing or damaged."""


class InvalidDataError(StoreError):
    """An argument or request is not valid."""


class ConflictError(StoreError):
    """A concurrent commit came first."""
