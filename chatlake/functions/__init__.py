"""Column expressions: text, time and JSON helpers (all built-in, JVM-side)."""

from chatlake.functions import json, text, time  # noqa: F401
