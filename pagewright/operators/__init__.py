"""pagewright.operators"""
