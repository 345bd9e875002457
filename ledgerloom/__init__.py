"""ledgerloom: provenance-preserving archive reconciliation on PySpark DataFrames."""
