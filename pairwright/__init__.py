"""Spark-native analytics for paired texts: a technical source and its plain-language version."""
