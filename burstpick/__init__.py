"""Spark jobs that cull very large photo archives."""
