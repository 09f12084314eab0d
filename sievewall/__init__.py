"""sievewall: a PySpark-native screening and corpus-preparation engine."""

__version__ = "0.1.0"
