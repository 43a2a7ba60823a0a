"""Builtin functions: natives of the interpreter, string formats, and their catalogue."""
