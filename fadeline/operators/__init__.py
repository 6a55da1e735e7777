"""Operators: DataFrame in, DataFrame out, no actions inside unless they say so."""
