"""Title and credit analytics on Spark DataFrames."""

from marquee.plans.concentration import top_share
from marquee.plans.debuts import debut_effect
from marquee.plans.gems import hidden_gems
from marquee.plans.ingest import ingest, load_check, load_check_stored, profile
from marquee.plans.overview import period_overview
from marquee.plans.registry import report, run, variants
from marquee.plans.returns import roi_by_decile, roi_skipped
from marquee.plans.stability import rating_stability

__all__ = [
    "debut_effect",
    "hidden_gems",
    "ingest",
    "load_check",
    "load_check_stored",
    "period_overview",
    "profile",
    "rating_stability",
    "report",
    "roi_by_decile",
    "roi_skipped",
    "run",
    "top_share",
    "variants",
]
