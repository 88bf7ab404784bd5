"""nomen.streaming"""
