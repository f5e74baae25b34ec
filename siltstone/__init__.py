"""Siltstone: batch risk analytics over package data, expressed as Spark jobs."""
