"""Registered queries, grouped by family."""
from importlib import import_module

FAMILIES = ("q_bars", "q_indicators", "q_triggers", "q_conditions", "q_rules", "q_joins", "q_market", "q_sources", "q_streaming")


def load_queries() -> None:
    for name in FAMILIES:
        try:
            import_module(f"{__name__}.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{name}":
                raise
