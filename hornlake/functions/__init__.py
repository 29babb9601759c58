from . import numeric, spatial, temporal
from .registry import Registry


def builtin() -> Registry:
    """The closed table of built-in operations."""
    from ..operators import planar

    return Registry([*numeric.OPERATIONS, *temporal.OPERATIONS, *spatial.OPERATIONS, *planar.OPERATIONS])
