"""nomen.plans"""
