"""pagewright.streaming"""
