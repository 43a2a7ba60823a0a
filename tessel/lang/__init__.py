"""The filter language: text to syntax tree."""

from .ast import Node
from .parser import ParseError, parse, parse_definitions

__all__ = ["Node", "ParseError", "parse", "parse_definitions"]
