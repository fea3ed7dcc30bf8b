"""provq.plans"""
