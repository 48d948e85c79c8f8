"""Parameters of the registered queries (shared by the Spark plans and the SQL oracle).

The driver tables name sources ``src0 .. src19`` instead of the seven mixture
names, so test mixtures give ``src{i}`` the weight of the ``i % 7``-th
mixture entry, normalised over all twenty sources.
"""

from __future__ import annotations

from .. import constants as K
from ..operators.sampling import SampleSpec, normalize_mix

N_SOURCES = 20
RATIO = 0.1
THRESHOLD = 512
CHUNK = 512
BUDGET_SMALL = 50_000
BUDGET_LARGE = 300_000


def _test_mix(base):
    raw = [(f"src{i}", base[i % len(base)][1]) for i in range(N_SOURCES)]
    return normalize_mix(raw)


MIX_TEST = _test_mix(K.ORIGINAL_MIX)
MIX_TEST_UPSAMPLED = _test_mix(K.UPSAMPLED_MIX)
MIX_MISSING = [m for m in MIX_TEST if m[0] != "src19"]
MIX_STARVED = MIX_TEST + [("ghost", MIX_TEST[0][1])]

SPEC_PER_SOURCE = SampleSpec(total_tokens=BUDGET_SMALL, mode="per_source", ratio=RATIO, threshold_tokens=THRESHOLD)
SPEC_PER_SOURCE_LARGE = SampleSpec(total_tokens=BUDGET_LARGE, mode="per_source", ratio=RATIO,
                                   threshold_tokens=THRESHOLD)
SPEC_UPSAMPLE = SampleSpec(total_tokens=BUDGET_LARGE, mode="upsample_code_arxiv_book", ratio=RATIO,
                           threshold_tokens=THRESHOLD)
SPEC_GLOBAL = SampleSpec(total_tokens=BUDGET_SMALL, mode="global", ratio=RATIO, threshold_tokens=THRESHOLD)
SPEC_NONE = SampleSpec(total_tokens=BUDGET_SMALL, mode="none", ratio=RATIO, threshold_tokens=THRESHOLD)
SPEC_LONG_THRESHOLD = SampleSpec(total_tokens=BUDGET_LARGE, mode="per_source", ratio=RATIO,
                                 threshold_tokens=K.DEFAULT_THRESHOLD_TOKENS)
SPEC_STARVED = SampleSpec(total_tokens=BUDGET_SMALL, mode="per_source", ratio=RATIO, threshold_tokens=THRESHOLD)

# QA
TRUNCATE_M = 101
TRUNCATE_TEXT_TOKENS = 1000
WINDOW_STEP = K.PREFILL_STEP
SENTENCE_DEPTHS = [0.0, 0.25, 0.5, 1.0]
RECALL_BUCKETS = 1024
SLICE_START = 2
SLICE_STOP = 8
N_SHARDS = 4
N_SEGMENTS = 4
STREAM_PARTS = 16
N_LANES = 3
TRIM_CHARS_LENGTH = 1000


def assistant_turns(spark, sf_dir):
    """Turns of the assistant: ``conv_id, turn, text``."""
    from ..sources.tables import read_table
    return read_table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")
