"""Keyloom: listings of object stores as ordinary Spark DataFrames."""
