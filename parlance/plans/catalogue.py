"""All registered queries; each plans module adds its own."""

from parlance.plans import corpus, quality, relational, review, roundtrips, statistics  # noqa: F401
from parlance.plans.registry import ORACLES, QUERIES  # noqa: F401
