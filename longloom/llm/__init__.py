"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only when it can
be imported.  Every operator takes DataFrames, writes reused intermediate results under
``spark.checkpoint.dir`` and returns a DataFrame.
"""
