"""lignum.streaming"""
