"""Readers and writers of sequence files, manifests, taxonomy dumps, run records and logs."""

from .readers import *  # noqa: F403
from .sinks import *  # noqa: F403
