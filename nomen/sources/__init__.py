"""nomen.sources"""
