"""Descriptors of passes and steps, the registry of step types, and the engine that runs them."""
