"""harrow: mine captured web pages for programme offers, as Spark jobs."""
from .config import DEFAULT, TEST, MiningConfig  # noqa: F401

__all__ = ["DEFAULT", "TEST", "MiningConfig"]
