"""Alignment-free comparative genomics on Spark: k-mer counting, flexible merging, distances, trees and their support."""

__version__ = "0.1.0"
