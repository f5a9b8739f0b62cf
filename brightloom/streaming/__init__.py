from . import queries  # noqa: F401
