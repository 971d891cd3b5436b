"""Sward: species-composition analytics as Spark DataFrame operators.

Every operator is a function from DataFrames to a lazy DataFrame.  Features are kept in
long form ``(row_id, feature_id, value)`` and only become ML vectors at the model boundary.
"""

__version__ = "0.1.0"
