"""barengine.operators"""
