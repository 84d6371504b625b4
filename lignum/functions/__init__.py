"""lignum.functions"""
