"""lignum.sources"""
