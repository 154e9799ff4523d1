"""strataq: a Spark-first multi-model analytics engine.

Every operator takes DataFrames and returns a DataFrame; planning and execution stay with Catalyst.
"""

__version__ = "0.1.0"
