"""Spark-native analytics for the composition of text collections.

``operators`` holds the DataFrame operators, ``functions`` column functions and small numeric
routines, ``sources`` readers and sinks, ``plans`` registered queries with their SQL, ``streaming``
the incremental form of the run-log summary.
"""
