"""Simulation, graph and matrix dataflows as Spark DataFrame programs."""
