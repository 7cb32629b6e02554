"""The same summaries over streams."""

from tallyforge.streaming.windows import *  # noqa: F403
