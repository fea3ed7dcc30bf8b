"""provq.operators"""
