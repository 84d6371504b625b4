"""lignum.operators"""
