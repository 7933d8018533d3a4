"""Paired-unit analytics on Spark DataFrames.

A *unit* (person, order, device) has two matched rows, its *sides* (1 = R, 2 = L). The package audits such
tables, builds cohorts and splits, fits and scores models, and compares a baseline with an augmented loss model.
"""
