"""Imports every module of this subpackage that registers queries."""

from . import align, chat, decontam, licenses, lines, lm, merkle, mixing, near, pii, pivots, substring, quality  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
