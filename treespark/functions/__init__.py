"""treespark.functions"""
