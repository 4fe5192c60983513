"""Tabular profiling, preparation, modelling and explanation as Spark jobs."""
