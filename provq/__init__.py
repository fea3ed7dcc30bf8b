"""provq: content-provenance analytics and corpus operators on PySpark DataFrames."""
