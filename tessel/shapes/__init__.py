"""Shapes: what inputs a program accepts and what outputs it gives, inferred without annotations."""

from .algebra import Shape
from .check import Mismatch, check, check_column, ill_typed
from .constraint import ConstraintInference
from .direct import DirectInference

__all__ = ["ConstraintInference", "DirectInference", "Mismatch", "Shape", "check", "check_column", "ill_typed"]
