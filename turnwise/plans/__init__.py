"""Queries over the driver tables, one per operator."""
from importlib import import_module

from .registry import PLANS  # noqa: F401

for _name in ("text_plans", "source_plans", "corpus_plans", "join_plans", "lane_plans", "fusion_plans",
              "metric_plans", "diagnostic_plans", "rowset_plans", "contract_plans", "stream_plans", "system_plans"):
    import_module(f"{__name__}.{_name}")
