"""citeweave: concept analytics over bibliographic corpora, written for Spark.

Every public function takes DataFrames and returns a DataFrame (or a Column for
``citeweave.functions``); nothing is collected on the driver.
"""

__version__ = "0.1.0"
