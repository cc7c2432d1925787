"""treespark.operators"""
