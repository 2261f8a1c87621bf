"""barengine.streaming"""
