"""What can go wrong, by whose doing. User-facing errors carry a plain message."""


class CellweaveError(Exception):
    """Base of all errors raised on purpose."""


class DataError(CellweaveError):
    """The data cannot be analysed."""


class MissingDataError(DataError):
    """A table, column or layer that an operator needs is absent."""


class IncompatibleDataError(DataError):
    """Tables do not fit together (too few shared genes, wrong kind of values)."""


class ParameterError(CellweaveError):
    """A parameter is out of bounds."""


class ProcessingError(CellweaveError):
    """A method failed on valid input."""


class DependencyError(CellweaveError):
    """An external model is not available here; the message names the native substitute."""
