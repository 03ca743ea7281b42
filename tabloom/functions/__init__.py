"""Expressions and distributed building blocks used by the operators."""
