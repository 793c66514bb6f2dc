"""Content-addressed deduplication and backup analytics as Spark DataFrame operators."""

from siltspark.config import EngineConfig

__all__ = ["Engine", "EngineConfig"]


def __getattr__(name: str):
    # Executors import operator modules only; the engine facade is loaded when asked for.
    if name == "Engine":
        from siltspark.engine import Engine

        return Engine
    raise AttributeError(name)
