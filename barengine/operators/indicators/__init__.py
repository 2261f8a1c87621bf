"""barengine.operators.indicators"""
