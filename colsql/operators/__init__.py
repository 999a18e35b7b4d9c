"""Operators that Spark lacks, as SQL expressions and DataFrame functions."""
