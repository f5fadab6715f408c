"""territoria: adoption forecasting and territorial prioritisation on Spark.

Every operator is a function from DataFrame(s) to a DataFrame, built from
Spark SQL / DataFrame / ML primitives with column names as parameters.
"""

__version__ = "0.1.0"
