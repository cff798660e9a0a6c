"""Typed errors raised where the caller asked for something that is not there."""


class ColumnNotFound(LookupError):
    """The table has no column of that name."""


class TableNotFound(LookupError):
    """The loader has no table of that name."""


class ConfigNotFound(LookupError):
    """No configuration row for that (agent, key)."""


class UnsupportedColumnType(TypeError):
    """The operator is not defined for that column type."""


class DimensionMismatch(ValueError):
    """A vector does not have the number of components the operator was given."""
