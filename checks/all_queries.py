"""All registered queries."""

from checks import cleaning, composition, evaluation, geography, learning  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
