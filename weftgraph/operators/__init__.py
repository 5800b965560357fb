"""Operators: decompositions, corpora, kernels, models and evaluation."""
