"""Query specifications and their planning into DataFrames."""
