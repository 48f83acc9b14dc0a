"""Alert analytics on Spark.

Every operator is a DataFrame -> DataFrame function built from Spark SQL
expressions, window functions, joins and ``pyspark.ml``; Python runs inside
tasks only where SQL cannot say it (FFT of image stamps, isolation-forest
growth, user hooks).
"""

from alertspark.session import get_spark, shared_path

__all__ = ["get_spark", "shared_path"]
