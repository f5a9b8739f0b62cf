from . import files  # noqa: F401
