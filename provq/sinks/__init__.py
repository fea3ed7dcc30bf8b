"""provq.sinks"""
