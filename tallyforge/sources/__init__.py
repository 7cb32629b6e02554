"""Tables in, sketches and their binary images out."""

from tallyforge.sources.images import *  # noqa: F403
from tallyforge.sources.store import *  # noqa: F403
