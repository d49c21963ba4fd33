"""Relational and spatial operators: DataFrames and parameters in, a lazy DataFrame out."""
