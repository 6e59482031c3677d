"""Spark-native early-warning analytics on a binary outcome.

Label convention: 1 = pass, 0 = at risk. Every "risk" metric treats class 0
as the class of interest.
"""

__version__ = "0.1.0"
