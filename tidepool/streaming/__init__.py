"""Structured Streaming: arriving sequence files, run states, log counts."""

from .streams import *  # noqa: F403
