"""All registered queries of the library but those of optional subpackages."""

from . import capture, gate, guarding, reading, recordings, reports, requests, sets, streams, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
