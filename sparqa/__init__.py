"""sparqa: retrieval-augmented question answering and answer evaluation on Spark.

Every operator is a DataFrame -> DataFrame function (usable with ``df.transform``)
or a Column expression builder. Model calls (embedder, responder, judge, tagger)
are pluggable batch functions; deterministic native stand-ins are the defaults.
"""

from sparqa.session import checkpoint_dir, get_spark, spread

__all__ = ["get_spark", "checkpoint_dir", "spread"]
