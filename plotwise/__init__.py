"""Spark-native admission, selection, layout, publishing and log analytics for large polygon-feature datasets."""
