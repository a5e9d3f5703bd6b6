"""Errors raised by the operators."""


class ColumnNotFoundError(ValueError):
    """No text or label column could be found in a source."""


class InvalidBinaryLabelError(ValueError):
    """Labels other than 0 and 1 are left after normalisation."""


class DatasetColumnMismatchError(ValueError):
    """Frames with different columns were to be merged."""


class UnknownMethodError(ValueError):
    """An embedding method, model or aggregation name is not known."""


class UnsupportedParameterError(ValueError):
    """A parameter has no counterpart in Spark and would be silently ignored."""
