"""Errors of the dialect and of tables."""

from __future__ import annotations


class SqlError(ValueError):
    """A statement that the dialect doesn't allow; offset is where in its text, if known."""

    def __init__(self, message: str, offset: int | None = None) -> None:
        super().__init__(message if offset is None else f"{message} (at {offset})")
        self.message, self.offset = message, offset


class ConstraintError(ValueError):
    """Rows that a table's key, types, checks or references don't allow. code: unique, null, check, reference, type, enum."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


class ConflictError(RuntimeError):
    """Another writer committed first, too often in a row."""
