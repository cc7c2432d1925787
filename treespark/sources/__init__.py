"""treespark.sources"""
