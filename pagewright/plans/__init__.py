"""pagewright.plans"""
