"""Code-change and test-coverage analytics as Spark DataFrame operators."""

from changelens.config import JobConfig

__all__ = ["JobConfig"]
