"""Errors of the library; each is also the builtin error of its name."""


class ColonnadeError(Exception):
    pass


class ColumnKeyError(ColonnadeError, KeyError):
    pass


class ColumnTypeError(ColonnadeError, TypeError):
    pass


class ColumnValueError(ColonnadeError, ValueError):
    pass


class ColumnIndexError(ColonnadeError, IndexError):
    pass


class EmptyReductionWarning(UserWarning):
    """``all`` or ``any`` was asked of values none of which is present."""
