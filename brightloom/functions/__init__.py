from . import collections, datetimes, misc, numbers, strings, texts  # noqa: F401
