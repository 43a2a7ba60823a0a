"""A Spark-native engine for JSON and tabular data with whole-program shape inference."""

from .api import Program, compile
from .lang import ParseError
from .shapes import Mismatch, Shape

__all__ = ["Mismatch", "ParseError", "Program", "Shape", "compile"]
