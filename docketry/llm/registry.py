"""The registry of this subpackage's queries; ``__spark_entry__`` adds it where the subpackage is installed."""

from docketry.registry import Registry

LLM = Registry()
