"""repolith: Spark-native analytics over source repositories.

The package is a set of DataFrame -> DataFrame functions; see README.md for the layout.
"""
