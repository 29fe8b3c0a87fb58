"""Ordered string dictionaries, automaton-style predicates and line sorting on Spark DataFrames."""
