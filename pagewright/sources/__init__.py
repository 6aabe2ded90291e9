"""pagewright.sources"""
