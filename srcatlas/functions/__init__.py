"""Column -> Column expressions."""

from . import codefacts, paths, text, vectors  # noqa: F401
