"""Catalogue analytics for runs and their file replicas, as Spark DataFrame jobs.

Every operator is a plain function from DataFrames to a DataFrame.  Nothing here
collects table rows to the driver; ``now``, hosts and thresholds are arguments.
"""

__version__ = "0.1.0"
