"""Quillmesh: building and scoring multi-hop question sets over layout-grounded documents, on Spark."""
