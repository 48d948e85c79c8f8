"""Query of the secret scan (a fitted forest has no SQL form: tests check held-out accuracy)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import secret_scan
from .common import read
from .registry import register


@register("op3_secret_scan")
def op3_secret_scan(spark, sf_dir):
    """Scored secret candidates of all documents."""
    r = secret_scan.scan(read(spark, sf_dir, "documents"))
    return r.select("doc_id", "pos", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"),
                    "label", F.round("p_secret", 6).alias("p_secret"), "is_secret")
