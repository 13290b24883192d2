"""quarry: hybrid text retrieval and corpus curation as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
to the driver except bounded configuration (word lists, edit lists) and
single-row size checks.
"""

from quarry.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
