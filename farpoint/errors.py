"""Exceptions raised by the engine."""


class FarpointError(Exception):
    """Base of all errors of this package."""


class ValidationError(FarpointError):
    """Inputs do not fit together."""


class ClusterSizeError(ValidationError):
    """A cluster has no more rows than the number of neighbours."""


class MissingValuesError(ValidationError):
    """A feature holds NULL or NaN."""
