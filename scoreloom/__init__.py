"""Spark jobs for large-scale pairwise text evaluation, bias statistics and corpus preparation."""
