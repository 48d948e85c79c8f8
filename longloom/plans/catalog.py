"""All registered queries (importing this module fills the registry)."""

from __future__ import annotations

from . import corpus, model, needle, packing, qa, streams  # noqa: F401


def flagship(spark, sf_dir):
    """Sampling -> tokenizing -> packing -> per-source profile of the packed segments."""
    return packing.q_segment_length_profile(spark, sf_dir)
