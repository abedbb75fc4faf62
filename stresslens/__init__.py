"""Evaluation of binary detectors under systematic perturbation, on Spark."""

__version__ = "0.1.0"
