"""Plumbline: spatial-capture analytics and measurement scoring on PySpark DataFrames."""
