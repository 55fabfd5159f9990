"""Spark-native analytics for publicly stated needs.

Stages are plain ``DataFrame -> DataFrame`` functions and ``Column`` helpers;
compose them with ``DataFrame.transform`` and let Catalyst plan the result.
"""
