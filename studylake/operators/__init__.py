"""Set-oriented operators: every one takes and returns DataFrames."""
