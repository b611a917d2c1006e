"""vspark.plans"""
