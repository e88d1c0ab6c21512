"""rareflag — rare-class flagging on Spark.

Clean, scale, normalise, split, balance, search, score and evaluate wide
tables of observations with Spark DataFrame, ``pyspark.ml`` and Structured
Streaming jobs.
"""

from rareflag.config import RunConfig
from rareflag.flagger import RareFlagger

__all__ = ["RareFlagger", "RunConfig"]
__version__ = "0.1.0"
