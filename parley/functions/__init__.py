"""Expressions and Arrow functions that operators are made of."""
