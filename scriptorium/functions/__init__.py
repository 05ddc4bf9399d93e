"""Column expressions.  Each function maps columns to a column and runs inside the JVM."""

from scriptorium.functions.registry import register_functions

__all__ = ["register_functions"]
