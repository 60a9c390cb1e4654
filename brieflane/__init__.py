"""brieflane — per-entity market briefs from landed posts, news, videos and quotes, on Spark.

Every operator is a DataFrame transformation; nothing is collected to the driver.
Entry points live in :mod:`brieflane.plans.api`; the query registry used by the
correctness gate lives in :mod:`brieflane.plans.registry`.
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
