"""lociframe: genome-scale data processing on the PySpark DataFrame API."""

__version__ = "0.1.0"
