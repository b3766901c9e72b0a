"""Set-based triage of job-run failures on Spark.

Every operator is a function of DataFrames, a ``Settings`` value and an explicit
point in time, and returns a DataFrame.
"""

from runmend.settings import Settings

__all__ = ["Settings"]
