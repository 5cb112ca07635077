"""docspark: retrieval analytics over document collections, as DataFrame plans."""

from .config import Settings
from .session import create_session

__all__ = ["Settings", "create_session"]
