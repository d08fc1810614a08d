"""Spark-native analytics for electrophysiology recordings.

Sub-packages
------------
functions   column expressions and numeric kernels
sources     readers, writers, metadata and window scans
operators   validation, matching, aggregation, statistics, detection, learning
plans       named queries with their SQL equivalents
streaming   Structured Streaming extension
"""
