"""Search and merge operators on DataFrames."""
