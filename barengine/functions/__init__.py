"""barengine.functions"""
