"""Column expressions shared by the operators (all JVM-side, no Python UDFs)."""

from setscope.functions.arrays import array_text
from setscope.functions.text import segment_text

__all__ = ["array_text", "segment_text"]
