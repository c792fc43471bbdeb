"""Errors of the dialect."""


class SqlError(Exception):
    """A failed statement; category says what kind of failure it was."""

    def __init__(self, message: str, category: str = "error"):
        super().__init__(message)
        self.category = category


class ConstraintError(SqlError):
    def __init__(self, message: str, kind: str):
        super().__init__(message, f"constraint_{kind}")
