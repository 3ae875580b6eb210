"""bazaarlens: marketplace analytics and policy evaluation as PySpark DataFrames."""

__version__ = "0.1.0"
