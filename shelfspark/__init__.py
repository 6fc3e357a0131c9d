"""Document-retrieval analytics as Spark jobs over tables."""

from shelfspark.config import Settings

__all__ = ["Settings"]
