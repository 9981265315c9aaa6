"""circuitlake: a Spark-native analytics engine for circuit-design data.

Operators take and return DataFrames (or Columns); nothing here collects data
whose size grows with the input.
"""

__version__ = "0.1.0"
