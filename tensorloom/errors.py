"""What operators raise."""


class TensorError(Exception):
    """Any error of this package."""


class ShapeMismatchError(TensorError, ValueError):
    """Operands whose numbers of modes or dimensions don't fit."""


class TensorValueError(TensorError, ValueError):
    """A malformed value, index or option."""


class TensorZeroDivisionError(TensorError, ZeroDivisionError):
    """Division by the scalar zero."""
