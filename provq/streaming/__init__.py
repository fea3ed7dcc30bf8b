"""provq.streaming"""
