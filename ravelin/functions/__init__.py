"""Functions of the engine, each a function on columns or DataFrames."""
