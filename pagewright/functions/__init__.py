"""pagewright.functions"""
