"""treespark.plans"""
