"""treespark.streaming"""
