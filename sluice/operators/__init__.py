"""Table-agnostic operators: every one takes and returns DataFrames."""
