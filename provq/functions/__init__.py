"""provq.functions"""
