"""nomen.operators"""
