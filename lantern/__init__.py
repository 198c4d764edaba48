"""Lantern: Spark-native operators for directory-style records and duty rosters."""
