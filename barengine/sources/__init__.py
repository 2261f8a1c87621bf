"""barengine.sources"""
