"""nomen.functions"""
