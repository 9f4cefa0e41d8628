"""altscore: alternative-data credit analytics on Spark.

The package is organised the way a Spark job is: ``sources`` load and shape
tables, ``functions`` hold reusable column expressions and fixed constants,
``operators`` are DataFrame -> DataFrame transformations, ``plans`` chain
operators into the queries that are registered with the driver, and
``streaming`` holds the Structured Streaming twins of the batch plans.
"""

__all__ = ["session"]
