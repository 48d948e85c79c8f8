"""Query of the chat formatter and its oracle."""

from __future__ import annotations

import re

from . import chat_format
from .common import read
from .registry import register

PROBE = "</s>[INST] ok [/INST]"
EXTRA = [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]

# the formatted length follows from the template: 12 + 1 + 11 characters a turn, doubled
# backslashes and one backslash for each control string
def _escaped(x: str) -> str:
    controls = "|".join(re.escape(c) for c in chat_format.CONTROL).replace("/", "/")
    return (f"(2 * len({x}) - len(replace({x}, '\\', '')) + len(regexp_extract_all("
            f"replace({x}, '\\', '\\\\'), '{controls}')))")


OP8_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + {_escaped('role')} + {_escaped('text')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@register("op8_chat_format", OP8_SQL)
def op8_chat_format(spark, sf_dir):
    """All conversations and the probe, formatted, written and read back."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return chat_format.formatted_digests(c.unionByName(probe))
