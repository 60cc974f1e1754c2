"""Registered query plans, one module per operator family."""
from importlib import import_module

FAMILIES = [
    "cleaning",
    "sources",
    "sequence",
    "joins",
    "resample",
    "indices",
    "profile",
    "diagnostics",
    "skill",
    "mapping",
    "trends",
    "space",
    "learn",
    "streaming",
]


def load_all():
    from squallframe.plans.registry import REGISTRY

    for family in FAMILIES:
        import_module(f"squallframe.plans.{family}")
    return REGISTRY
