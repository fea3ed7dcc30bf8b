"""provq.sources"""
