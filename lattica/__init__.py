"""lattica: a property-graph query and analytics engine on PySpark DataFrames."""
