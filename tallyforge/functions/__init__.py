"""Column functions: hashes for the relational summaries and bounds of their estimates."""

from tallyforge.functions.bounds import *  # noqa: F403
from tallyforge.functions.hashing import *  # noqa: F403
