"""Image-based cell screening on PySpark.

Plates of microscopy images become pixel, object, feature and geometry tables;
every operator is a ``DataFrame -> DataFrame`` function that Spark plans,
partitions and shuffles.
"""

__version__ = "0.1.0"
