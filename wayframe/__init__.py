"""wayframe: linear-network analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame.  Identifiers such as
"""

__version__ = "0.1.0"
