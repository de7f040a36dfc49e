"""Compositions of operators that answer a whole question in one job."""
