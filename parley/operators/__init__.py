"""Operators over the conversation table: each takes a DataFrame and returns one."""
