"""Logical plans: binding of paths to the model and their DataFrames."""
