"""Functions on columns that Spark has under another name or not at all."""

from .arrays import *  # noqa: F403
from .scalar import *  # noqa: F403
from .vector import *  # noqa: F403
