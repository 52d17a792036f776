"""edgeloom: graph analytics and table processing on PySpark DataFrames."""
