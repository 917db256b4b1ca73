"""Program-analysis and property-graph analytics as PySpark DataFrames."""
